"""Secret scans by a trigram inverted index, in DataFrame operations only.

Every rule is a regular expression. From its parse tree follows a Boolean query: sets
of trigrams of which each match contains at least one set whole. The index lists, for
each trigram that some rule asks for, the rows that hold it; a rule's candidates are
the rows in all postings of one of its sets. Candidates are verified by the rule
itself. Rules from which no trigram follows are tried on every row.
"""

from __future__ import annotations

import json
from itertools import product
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.licenses import running
from foliant.llm.shared import empty_if_null, written

# The kinds that always count. Of each match so many characters of a group are needed.
BASE_KINDS = ("assign", "access", "hex")
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of 32 or more, which are whole runs
)
# Further kinds, by the forms in which their issuers publish them.
MORE = (
    ("aws_key", r"A(?:SIA|GPA|ROA|IDA|NPA|NVA|IPA)[A-Z0-9]{16}", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("github", r"github_pat_[A-Za-z0-9_]{22,}", 0, 0),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 0),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("slack", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("google", r"ya29\.[A-Za-z0-9_-]{20,}", 0, 0),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 0),
    ("npm", r"npm_[A-Za-z0-9]{36}", 0, 0),
    ("pypi", r"pypi-[A-Za-z0-9_-]{32,}", 0, 0),
    ("docker", r"dckr_pat_[A-Za-z0-9_-]{20,}", 0, 0),
    ("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", 0, 0),
    ("digitalocean", r"do[opr]_v1_[0-9a-f]{64}", 0, 0),
    ("databricks", r"dapi[0-9a-f]{32}", 0, 0),
    ("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY[A-Z ]{0,8}-----", 0, 0),
    ("url", r"(?i:[a-z][a-z0-9+.-]{1,15})://[^\x00-\x20/:@\x22\x27<>]{1,64}:[^\x00-\x20/:@\x22\x27<>]{3,64}@", 0, 0),
    ("bearer", r"(?i:authorization)\x20*[:=]\x20*(?i:bearer|basic)\x20+[A-Za-z0-9+/_.=-]{8,}", 0, 0),
    ("assign_more", r"""(?i:(?:client_?secret|access_?key|private_?key|credentials?|pwd))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", 0, 0),
)
RULES = tuple({"rank": i, "kind": kind, "regex": regex, "group": group, "least": least, "base": kind in BASE_KINDS}
              for i, (kind, regex, group, least) in enumerate(BASE + MORE))
STRINGS = 32  # alternatives of one literal stretch that are followed up
SETS = 24  # sets of one query
# Candidates up to so many rows (16 bytes each) are sent to all tasks; beyond that they are joined by shuffling.
BROADCAST_CANDIDATES = 2_000_000

SPAN = "struct<start: int, rank: int, kind: string, stop: int, base: boolean>"

Query = frozenset  # of frozensets of trigrams: one of them is whole in every match; an empty set demands nothing
ANY: Query = Query([frozenset()])


def _either(a: Query, b: Query) -> Query:
    both = a | b
    least = Query(s for s in both if not any(t < s for t in both))
    return least if len(least) <= SETS else ANY


def _both(a: Query, b: Query) -> Query:
    found = Query(x | y for x, y in product(a, b))
    found = Query(s for s in found if not any(t < s for t in found))
    if len(found) <= SETS:
        return found
    return min((q for q in (a, b) if q != ANY), key=len, default=ANY)  # either of the two is demanded by itself


def _trigrams(strings: frozenset[str]) -> Query:
    found = ANY if not strings else None
    for s in strings:
        one = Query([frozenset(s[i: i + 3] for i in range(len(s) - 2))])
        found = one if found is None else _either(found, one)
    return found


def _few(items) -> frozenset[str] | None:
    """The characters of a small class, in lower case."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            chars.add(chr(value).lower())
        elif kind is c.RANGE and value[1] - value[0] < 4:
            chars |= {chr(v).lower() for v in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(chars) if len(chars) <= 6 else None


def _derived(tree) -> tuple[frozenset[str] | None, Query]:
    """(all strings that ``tree`` can match, if they are few; the query that each match meets), in lower case."""
    strings: frozenset[str] | None = frozenset([""])  # of the stretch since the last piece that is not few strings
    whole, query = True, ANY
    for kind, value in tree:
        exact, demanded = None, ANY
        if kind is c.LITERAL:
            exact = frozenset([chr(value).lower()])
        elif kind is c.IN:
            exact = _few(value)
        elif kind is c.SUBPATTERN:
            exact, demanded = _derived(value[3])
        elif kind is c.BRANCH:
            parts = [_derived(part) for part in value[1]]
            if all(p[0] is not None for p in parts):
                exact = frozenset().union(*[p[0] for p in parts])
            demanded = parts[0][1]
            for _, more in parts[1:]:
                demanded = _either(demanded, more)
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, inner = value
            found, once = _derived(inner)
            if found is not None and most <= 1:
                exact = found if least else found | {""}
            elif found is not None and least == most <= 4:
                exact = frozenset(map("".join, product(found, repeat=int(least))))
            demanded = once if least else ANY
        joined = None if exact is None else frozenset(a + b for a, b in product(strings, exact))
        if joined is not None and len(joined) <= STRINGS:
            strings = joined
            continue
        query = _both(_both(query, _trigrams(strings)), demanded if exact is None else _trigrams(exact))
        strings, whole = frozenset([""]) if exact is None else exact, False
        if len(strings) > STRINGS:
            strings = frozenset([""])
    return (strings if whole else None), _both(query, _trigrams(strings))


def trigram_query(regex: str) -> Query:
    """Sets of trigrams of which every match of ``regex``, in lower case, contains one whole; an empty set if nothing is sure."""
    return _derived(parser.parse(regex))[1]


def _rules_frame(spark, rules) -> tuple[DataFrame, list[dict]]:
    """(rank, part, needed, trigram) of the rules that have a query, and the rules that have none."""
    terms, rest = [], []
    for rule in rules:
        query = trigram_query(rule["regex"])
        if any(not s for s in query):
            rest.append(rule)
            continue
        for part, found in enumerate(sorted(map(sorted, query))):
            terms += [{"rank": rule["rank"], "part": part, "needed": len(found), "trigram": t} for t in found]
    shape = "array<struct<rank: int, part: int, needed: int, trigram: string>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(terms)), shape))), rest


def trigram_index(rows: DataFrame, trigrams: list[str], key_col: str = "n", text_col: str = "text") -> DataFrame:
    """(trigram, key): postings of the given trigrams, in texts taken in lower case."""
    small = rows.select(F.col(key_col).alias("key"), F.lower(text_col).alias("small"))
    held = F.array_compact(F.array(*[F.when(F.contains("small", F.lit(t)), F.lit(t)) for t in trigrams]))
    return small.select("key", F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, ranks): the rules that a row may match, from the intersections of their postings."""
    hits = index.join(F.broadcast(terms), "trigram").groupBy("key", "rank", "part").agg(F.count("*").alias("held"), F.first("needed").alias("needed"))
    return hits.where("held = needed").groupBy("key").agg(F.collect_set("rank").alias("ranks"))


def _spans(text: Column, rules: Column) -> Column:
    """Matches of ``rules`` in ``text``, ordered by place and rule."""
    none = F.array().cast(f"array<{SPAN}>")

    def tried(rule: Column) -> Column:
        return let(F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(rule, found)).otherwise(none))

    def placed(rule: Column, found: Column) -> Column:
        pieces = F.split(text, rule["regex"], -1)
        judged = F.when(rule["group"] > 0, F.regexp_extract_all(text, rule["regex"], rule["group"])).otherwise(found)
        sizes = F.transform(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("p"), found.alias("m"), judged.alias("g")), lambda x: F.struct(
            F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("size"), F.char_length(x["g"]).alias("judged")))
        return let(sizes, lambda known: F.transform(F.filter(
            F.arrays_zip(running(known, F.lit(0), "int", lambda at, x: at + x["gap"] + x["size"]).alias("stop"), known.alias("d")),
            lambda x: x["d"]["judged"] >= rule["least"]), lambda x: F.struct(
                (x["stop"] - x["d"]["size"]).alias("start"), rule["rank"].alias("rank"), rule["kind"].alias("kind"), x["stop"].alias("stop"),
                rule["base"].alias("base"))))

    return F.array_sort(F.flatten(F.transform(rules, tried)))


def _without_inner(spans: Column) -> Column:
    """``spans`` without the added ones that lie within a base span."""
    far = lambda held: running(held, F.lit(0), "int", lambda reach, s: F.greatest(reach, F.when(s["base"], s["stop"]).otherwise(0)))
    # At equal starts base spans come first by rank, so the reach of base spans up to a span decides.
    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(let(far(s), lambda reach: F.filter(
        s, lambda x, i: x["base"] | (F.get(reach, i) < x["stop"])))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
                 broadcast_candidates: int = BROADCAST_CANDIDATES) -> DataFrame:
    """(id, spans) of every row; spans are (start, rank, kind, stop, base) by start and then rule, in code points, the end exclusive.

    Base rules' matches always stay; another rule's match goes if it lies within one of
    them. Spans of different added rules may overlap. Null texts count as empty. Rows
    with the same id or text keep rows of their own; an empty table gives none. Other
    columns, whatever their names, are not read. Texts are taken whole, however long.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col(id_col).alias("id"), empty_if_null(F.col(text_col).cast("string")).alias("text"), F.monotonically_increasing_id().alias("n")))
    terms, rest = _rules_frame(spark, rules)
    trigrams = sorted({t for rule in rules if rule not in rest for s in trigram_query(rule["regex"]) for t in s})
    shape = "array<struct<rank: int, kind: string, regex: string, group: int, least: int, base: boolean>>"
    table = F.from_json(F.lit(json.dumps(list(rules))), shape)
    always = F.array(*[F.lit(rule["rank"]) for rule in rest]).cast("array<int>")
    if trigrams:
        found = written(candidates(trigram_index(rows, trigrams), terms))
        near = found.count() <= broadcast_candidates
        rows = rows.join(F.broadcast(found) if near else found, F.col("n") == F.col("key"), "left").select(
            "id", "text", F.concat(always, F.coalesce("ranks", F.array().cast("array<int>"))).alias("ranks"))
    else:
        rows = rows.select("id", "text", always.alias("ranks"))
    by_rank = F.filter(table, lambda r: F.array_contains("ranks", r["rank"]))
    # A rule that is tried on every row is cheaper to ask first whether it occurs at all.
    met = F.lit(False)
    for rule in rest:
        met = met | F.col("text").rlike(rule["regex"])
    some = (F.size("ranks") > len(rest)) | met
    return rows.select("id", F.when(some, _without_inner(_spans(F.col("text"), by_rank))).otherwise(F.array().cast(f"array<{SPAN}>")).alias("spans"))
