import random
import re
from itertools import combinations

from foliant.llm.decontaminate import SPACED, SUBSTITUTIONS, WINDOW, leaked_documents, without_leaks


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, items):
    out = {}
    for i, text in docs:
        d, hit = words(text), set()
        for item, b in items:
            b = words(b)
            size, allowed = (WINDOW, SUBSTITUTIONS) if len(b) >= WINDOW else (len(b), 0)
            if len(b) >= 5 and any(sum(x != y for x, y in zip(d[p:p + size], b[q:q + size])) <= allowed
                                   for p in range(len(d) - size + 1) for q in range(len(b) - size + 1)):
                hit.add(item)
        if hit:
            out[i] = sorted(hit)
    return out


def fixture():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (3, "a b c d e f")]
    docs = []
    for i in range(120):
        text = prose(rng.randint(0, 80))
        if i % 2:
            part = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                if part:
                    part[rng.randrange(len(part))] = "Other"
            part = part[rng.randint(0, 3):]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((i, ", ".join(text)))
    return docs + [(200, None), (201, "")], items


def test_matches_brute_force(spark):
    docs, items = fixture()
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame([(*b, 2) for b in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    assert want
    for limit in (1_000_000, 0):
        got = leaked_documents(left, right, broadcast_seeds=limit).collect()
        assert {r["id"]: r["item_ids"] for r in got} == want and len(got) == len(want)
    kept = without_leaks(left.union(left.where("doc_id < 4")), right)
    assert kept.columns == left.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([i for i, _ in docs if i not in want] + [i for i in range(4) if i not in want])
    assert leaked_documents(left, right.limit(0)).count() == 0 and leaked_documents(left.limit(0), right).count() == 0
    assert without_leaks(left, right.limit(0)).count() == len(docs)


def test_mask_survives_every_allowed_substitution():
    ones = [i for i, bit in enumerate(SPACED) if bit == "1"]
    for spoiled in combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(not {s + i for i in ones} & set(spoiled) for s in range(WINDOW - len(SPACED) + 1))


def plain_every_length(docs, items):
    def split(text):
        return re.findall(r"[^\W_぀-ヿ一-鿿]+|[぀-ヿ一-鿿]", (text or "").lower())

    out = {}
    for i, text in docs:
        d = split(text)
        hit = set()
        for item, b in items:
            b = split(b)
            size = min(len(b), WINDOW)
            if size and any(sum(x != y for x, y in zip(d[p:p + size], b[q:q + size])) <= size * SUBSTITUTIONS // WINDOW
                            for p in range(len(d) - size + 1) for q in range(len(b) - size + 1)):
                hit.add(item)
        if hit:
            out[i] = sorted(hit)
    return out


def test_items_of_every_length_match_brute_force(spark):
    rng = random.Random(8)
    docs = fixture()[0]
    items = [(n, " ".join(f"q{n}x{i}" for i in range(n))) for n in range(1, 20)] + [(50, "水は何度で沸騰しますか、摂氏で答えよ"), (51, "天地玄黄")]
    at = 300
    for item, text in items:
        for changes in range(4):
            part = list(text) if item >= 50 else text.split()
            for j in rng.sample(range(len(part)), min(changes, len(part))):
                part[j] = "变" if item >= 50 else "other"
            docs.append((at, "before " + ("" if item >= 50 else " ").join(part) + " after"))
            at += 1
    want = plain_every_length(docs, items)
    assert sum(14 in v for v in want.values()) == 2 and sum(3 in v for v in want.values()) == 1 and any(50 in v for v in want.values())
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = leaked_documents(left, right, every_length=True).collect()
    assert {r["id"]: r["item_ids"] for r in got} == want


def test_short_masks_survive_every_allowed_substitution():
    from foliant.llm.decontaminate import short_mask

    for n in range(1, WINDOW):
        allowed = n * SUBSTITUTIONS // WINDOW
        mask = short_mask(n, allowed)
        assert len(mask) + allowed <= n
        for spoiled in combinations(range(n), allowed):
            assert any(not {s + i for i, bit in enumerate(mask) if bit == "1"} & set(spoiled) for s in range(allowed + 1))
