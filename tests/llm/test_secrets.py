import random
import re

from foliant.llm import secrets as S

SHAPE = "doc_id long, text string, n long, spans string, key string, ranks string"


def plain(text, rules=S.RULES):
    """Every rule on every text."""
    found = []
    for r in rules:
        for m in re.finditer(r["regex"], text or ""):
            if len(m[r["group"]]) >= r["least"]:
                found.append((m.start(), r["rank"], r["kind"], m.end(), r["base"]))
    return sorted(s for s in found if s[4] or not any(b[4] and b[0] <= s[0] and s[3] <= b[3] for b in found))


def texts():
    rng = random.Random(12)
    word = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = "ABCDEFxyz0123456789"
    parts = ["password", "PassWD", "api_key", "APIKEY", "token", "secret", "Secret", ":", "=", " = ", '"', "'", " ", "é", "😀", "\n", "AKIA", "abc", "deadbeef" * 4,
             "0123456789abcdef" * 3, "AKIA" + word(alnum.upper(), 16), "ghp_" + word(alnum, 36), "xoxb-" + word(alnum, 14), "AIza" + word(alnum, 35),
             "sk_live_" + word(alnum, 20), "eyJ" + word(alnum, 12) + ".eyJ" + word(alnum, 10) + "." + word(alnum, 10), "-----BEGIN RSA PRIVATE KEY-----",
             "-----BEGIN PRIVATE KEY-----", "https://bob:hunter22@example.com/x", "Authorization: Bearer " + word(alnum, 20), "client_secret=" + word(alnum, 10),
             "12345678:AA" + word(alnum, 33), "hunter22", "longer/value+9", "dapi" + "0f" * 16, "SG." + word(alnum, 18) + "." + word(alnum, 18)]
    out = [None, "", "password:token:abcdefghijk", "secret=token=abcdefghijk", "AKIAAKIA12345678", "AKIA12345678901", "KEY K token=abcdefgh", "İ api_key = x1y2z3w4"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    out.append("token=abcdefgh " * 700 + "deadbeef" * 5000)  # many matches and a very long one
    return out


def test_spans_equal_plain_scans(spark):
    rows = [(i // 2, t, 1, "x", "y", "z") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SHAPE).coalesce(1)
    want = [plain(t) for _, t, *_ in rows]
    for limit in (S.BROADCAST_CANDIDATES, 0):  # candidates sent to the tasks, or joined by shuffling
        got = [(r["id"], [tuple(s) for s in r["spans"]]) for r in S.find_secrets(docs, broadcast_candidates=limit).collect()]
        assert sorted(got) == sorted((r[0], w) for r, w in zip(rows, want))
    assert {s[2] for w in want for s in w} > {"assign", "access", "hex", "github", "jwt", "private_key", "url", "bearer"}
    assert S.find_secrets(docs.limit(0)).count() == 0


def test_every_match_meets_its_query():
    for rule in S.RULES:
        query = S.trigram_query(rule["regex"])
        for text in filter(None, texts()):
            for m in re.finditer(rule["regex"], text):
                assert any(all(t in m[0].lower() for t in s) for s in query), (rule["kind"], m[0])
    assert [r["kind"] for r in S.RULES if frozenset() in S.trigram_query(r["regex"])] == ["hex"]


def test_queries_of_small_expressions():
    shown = lambda regex: sorted(map(sorted, S.trigram_query(regex)))
    assert shown("abcd") == [["abc", "bcd"]]
    assert shown("ab(c|D)e?f") == [["abc", "bce", "cef"], ["abc", "bcf"], ["abd", "bde", "def"], ["abd", "bdf"]]
    assert shown("abc[0-9]+xyz|pqr") == [["abc", "xyz"], ["pqr"]]
    assert shown("(abc)*") == shown("a.c") == shown("abc|de") == [[]]
    assert shown("x{3}y") == [["xxx", "xxy"]]
    assert shown("(?:foo)+b") == [["foo"]]


def test_rules_without_trigrams_scan_fully(spark):
    rules = [{"rank": i, "kind": k, "regex": r, "group": 0, "least": 0, "base": False} for i, (k, r) in enumerate((("d", "[0-9]{3}"), ("e", "ab")))]
    docs = spark.createDataFrame([(1, "x 123456 ab"), (2, None), (3, "none")], "doc_id long, text string")
    got = {r["id"]: [(s["start"], s["kind"], s["stop"]) for s in r["spans"]] for r in S.find_secrets(docs, rules=rules).collect()}
    assert got == {1: [(2, "d", 5), (5, "d", 8), (9, "e", 11)], 2: [], 3: []}
