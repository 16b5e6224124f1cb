"""License scans by ordered signature rules, in DataFrame operations only.

Rules are regular expressions made from license names, versions and the forms in
which texts state them. Keywords that every match of a rule contains, each without
spaces as any white space may stand between words, decide whether the rule is
tried on a text. A detection inside another is suppressed, and of
those that overlap in part the rule that comes first wins.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.shared import empty_if_null

# The phrases that always count, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BLOCK = 256
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# Fixed values: (label, keyword in lower case, name as a pattern, short name, versions). Parts of a keyword joined by + are all needed.
FAMILIES = (
    ("gpl", "general+public+licen", r"(?:gnu )?general public licen[sc]e", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "general+public+licen", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "agpl", ("1.0", "3.0")),
    ("fdl", "free+documentation", r"(?:gnu )?free documentation licen[sc]e", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "epl", ("1.0", "2.0")),
    ("cddl", "common+development", r"common development and distribution licen[sc]e", "cddl", ("1.0", "1.1")),
    ("cpl", "common+public", r"common public licen[sc]e", "cpl", ("1.0",)),
    ("eupl", "european+union", r"european union public licen[sc]e", "eupl", ("1.0", "1.1", "1.2")),
    ("osl", "open+software", r"open software licen[sc]e", "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic+free", r"academic free licen[sc]e", "afl", ("1.1", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", r"artistic licen[sc]e", "artistic", ("1.0", "2.0")),
    ("ofl", "open+font", r"(?:sil )?open font licen[sc]e", "ofl", ("1.0", "1.1")),
    ("bsl", "boost", r"boost software licen[sc]e", "bsl", ("1.0",)),
    ("odbl", "open+database", r"open (?:data commons )?(?:open )?database licen[sc]e", "odbl", ("1.0",)),
    ("mit", "mit+licen", r"(?:the )?mit licen[sc]e", "mit", ()),
    ("bsd-2", "bsd", r"(?:2|two)[ -]clause bsd licen[sc]e|simplified bsd licen[sc]e|bsd[ -]2[ -]clause(?: licen[sc]e)?", "bsd-2-clause", ()),
    ("bsd-3", "bsd", r"(?:3|three)[ -]clause bsd licen[sc]e|new bsd licen[sc]e|bsd[ -]3[ -]clause(?: licen[sc]e)?", "bsd-3-clause", ()),
    ("bsd", "bsd+licen", r"bsd licen[sc]e", "bsd", ()),
    ("isc", "isc+licen", r"isc licen[sc]e", "isc", ()),
    ("zlib", "zlib+licen", r"zlib(?:/libpng)? licen[sc]e", "zlib", ()),
    ("unlicense", "unlicense", r"the unlicense", "unlicense", ()),
    ("wtfpl", "what+want+public+licen", r"do what the f[\w*]+ you want to public licen[sc]e", "wtfpl", ()),
    ("psf", "python+software", r"python software foundation licen[sc]e", "psf", ("2.0",)),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms-pl", ()),
    ("cc0", "cc0", r"cc0(?: universal)?", "cc0", ("1.0",)),
    ("cc-by", "cc", r"cc[ -]by", "cc-by", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc", r"cc[ -]by[ -]sa", "cc-by-sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc", r"cc[ -]by[ -]nc", "cc-by-nc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc", r"cc[ -]by[ -]nd", "cc-by-nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc", r"cc[ -]by[ -]nc[ -]sa", "cc-by-nc-sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc", r"cc[ -]by[ -]nc[ -]nd", "cc-by-nc-nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc", "creative+commons", r"creative commons(?:[ -]attribution)?(?:[ -][a-z]{2,13}){0,4}(?: v?\d(?:\.\d)?(?: [a-z]{2,13}){0,3})? licen[sc]e", "cc", ()),
)
# Short names that are license names wherever a version follows them.
SHORT = ("gpl", "lgpl", "agpl", "gfdl", "apache", "cddl", "eupl", "odbl")
# What stands before a name in a notice.
NOTICE = r"(?:licen[sc]ed|released|distributed|published|available|provided|dual[ -]licen[sc]ed) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"
# Notices that name no license.
GENERAL = (
    ("all-rights-reserved", "rights+reserved", r"all rights reserved"),
    ("public-domain", "public+domain", r"(?:placed|dedicated|released|is) (?:in|to|into) the public domain"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("redistribution", "redistribution", r"redistribution and use in source and binary forms"),
    ("as-is", "without+warranty", r"provided [\"'“]?as is[\"'”]?,? without warranty"),
    ("permission", "permission+hereby", r"permission is hereby granted,? free of charge"),
)


def _loose(pattern: str) -> str:
    """Any white space where the pattern has a space, alone or as the choice of a space or a hyphen."""
    out, inside = [], False
    for c in pattern.replace("[ -]", "(?: |-)"):
        inside = c == "[" or inside and c != "]"
        out.append(r"(?:\s{1,9})" if c == " " and not inside else c)
    return "".join(out)


def _version(number: str) -> str:
    major, _, minor = number.partition(".")
    tail = rf"(?:\.{minor})?" if minor == "0" else rf"\.{minor}"
    return rf"{major}{tail}(?![\w.]*\d)"


def signature_rules() -> list[dict]:
    """All rules in order: the fuller the statement, the earlier its rules."""
    rules = []

    def add(label, keyword, pattern):
        rules.append({"label": label, "keyword": keyword, "regex": rf"(?i)(?<![\w-]){_loose(pattern)}(?![\w])"})

    between = r"(?:,? ?(?:version|v\.?|ver\.?)? ?)"
    for label, _, _, short, versions in FAMILIES:
        for v in versions or ("",):
            tail = "-" + v.replace(".", r"\.") if v else ""
            add(f"{label}-{v}" if v else label, "spdx", rf"spdx-license-identifier: ?{short}{tail}(?:-only|-or-later|\+)?")
    for label, keyword, name, _, versions in FAMILIES:
        for v in versions:
            add(f"{label}-{v}", keyword, rf"{NOTICE}(?:{name}){between}{_version(v)}")
    for label, keyword, name, _, versions in FAMILIES:
        for v in versions:
            add(f"{label}-{v}", keyword, rf"(?:{name}){between}{_version(v)}")
    for label, keyword, name, _, _ in FAMILIES:
        add(label, keyword, rf"{NOTICE}(?:{name})")
    for label, keyword, name, _, _ in FAMILIES:
        add(label, keyword, rf"(?:{name})")
    for label, _, _, short, versions in FAMILIES:
        for v in versions if short in SHORT else ():
            add(f"{label}-{v}", short, rf"{short}(?: |-)?v?{_version(v)}")
    for label, keyword, pattern in GENERAL:
        add(label, keyword, pattern)
    return [{"rank": i, **rule} for i, rule in enumerate(rules)]


def _any_case(text: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


def _phrase(phrase: str) -> str:
    return rf"(?<!{WORD})" + f"{GAP}+".join(map(_any_case, phrase.split(" "))) + rf"(?!{WORD})"


def _one_is(places: str, pattern: str) -> Column:
    return F.exists(places, lambda m: m.rlike(pattern))


def _words(text) -> Column:
    """How many words a text has: the pieces between gaps, less an empty one at either end."""
    def count(pieces: Column) -> Column:
        ends = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
        return (F.size(pieces) - ends).cast("long")

    return let(F.split(text, f"{GAP}+", -1), count)


def _found(text: Column, small: Column, rules: list[dict]) -> Column:
    """Detections of all rules whose keyword the text contains, ordered by start, then by length, then by rule."""
    by_keyword: dict[str, list[dict]] = {}
    for rule in rules:
        by_keyword.setdefault(rule["keyword"], []).append({k: rule[k] for k in ("rank", "label", "regex")})
    table = F.from_json(F.lit(json.dumps(by_keyword)), "map<string, array<struct<rank: int, label: string, regex: string>>>")
    held = F.filter(F.map_keys(table), lambda k: F.forall(F.split(k, r"\+"), lambda part: F.contains(small, part)))
    tried = F.flatten(F.transform(held, lambda k: F.element_at(table, k)))

    def spans(rule: Column) -> Column:
        found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
        return let(found, lambda matches: F.when(F.size(matches) > 0, located(rule, F.split(text, rule["regex"], -1), matches)).otherwise(
            F.array().cast("array<struct<start: int, back: int, rank: int, label: string, stop: int>>")))

    def located(rule: Column, pieces: Column, matches: Column) -> Column:
        # What stands between the matches and the matches themselves add up to the places.
        sizes = F.transform(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m")), lambda x: F.struct(
            F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("size")))
        return let(sizes, lambda known: F.transform(
            F.arrays_zip(running(known, F.lit(0), "int", lambda at, x: at + x["gap"] + x["size"]).alias("stop"), known.alias("d")),
            lambda x: F.struct((x["stop"] - x["d"]["size"]).alias("start"), (-x["stop"]).alias("back"), rule["rank"].alias("rank"),
                               rule["label"].alias("label"), x["stop"].alias("stop"))))

    return F.array_sort(F.flatten(F.transform(tried, spans)))


def running(items: Column, first: Column, kind: str, step) -> Column:
    """What ``step(state, item)`` is after each of ``items``, as an array.

    Arrays grow by whole blocks, so that a text with many matches is not copied once for each.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda state: F.struct(state.alias("state"), F.array_append(acc["out"], state).alias("out")))

    def block(acc: Column, at: Column) -> Column:
        part = F.aggregate(F.slice(items, at, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), within)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], p["out"]).alias("out")))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, F.struct(first.cast(kind).alias("state"), none.alias("out")), block, lambda acc: acc["out"])


def _resolved(found: Column) -> Column:
    """Detections that hold, of ``found`` ordered by start, then by length, then by rule.

    One that lies within another goes, whichever rules they are of. The others are
    taken in the order of their rules, each if it overlaps none that was taken.
    """
    shape = "struct<start: int, back: int, rank: int, label: string, stop: int>"

    def outermost(held: Column) -> Column:
        reach = running(held, F.lit(0), "int", lambda far, d: F.greatest(far, d["stop"]))
        return F.filter(held, lambda d, i: (i == 0) | (F.get(reach, i - 1) < d["stop"]))

    def taken(cluster: Column) -> Column:
        ranked = F.array_sort(F.transform(cluster, lambda d: F.struct(d["rank"].alias("by"), d["start"].alias("at"), d.alias("d"))))
        none = F.array().cast(f"array<{shape}>")
        return F.array_sort(F.aggregate(ranked, none, lambda acc, x: F.when(
            F.exists(acc, lambda t: (t["start"] < x["d"]["stop"]) & (x["d"]["start"] < t["stop"])), acc).otherwise(F.array_append(acc, x["d"]))))

    def clustered(held: Column) -> Column:
        # None lies within another, so stops are in the order of starts, and what overlaps is a run of neighbours.
        begins = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i)["start"] >= F.get(held, i - 1)["stop"]))
        return let(begins, lambda b: F.flatten(F.transform(b, lambda lo, i: let(
            F.slice(held, lo + 1, F.coalesce(F.get(b, i + 1), F.size(held)) - lo), lambda run: F.when(F.size(run) == 1, run).otherwise(taken(run))))))

    return let(found, lambda f: F.when(F.size(f) < 2, f).otherwise(let(outermost(f), clustered)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, detections, score) of every row.

    ``detections`` are (start, stop, rank, label) of the rules' matches that hold, in
    code points; ``base_labels`` and ``labels`` are sorted arrays without repetition;
    ``score`` is the share of the text that detections cover. Null texts count as
    empty: no words, no places, null first and last word, score 0. Rows are scanned
    independently of each other, so equal rows stay separate; an empty table gives none.
    """
    rules = signature_rules() if rules is None else rules
    phrase = "(?:" + "|".join(_phrase(p) for p, _ in PHRASES) + ")"
    rows = docs.select(F.col(id_col).alias("id"), empty_if_null(F.col(text_col).cast("string")).alias("text"))
    text = F.col("text")
    none = "array<struct<start: int, back: int, rank: int, label: string, stop: int>>"
    # Plain containment decides which texts meet a regular expression at all. Most rules need "licen".
    small = F.col("small")
    has = lambda *words: reduce(lambda a, b: a & b, [F.contains(small, F.lit(w)) for w in words])
    keys = sorted({("licen",) if "licen[sc]e" in r["regex"] and "clause" not in r["regex"] else ("cc", "by") if r["keyword"] == "cc" else tuple(r["keyword"].split("+")) for r in rules})
    gate = reduce(lambda a, b: a | b, [has(*k) for k in keys], F.lit(False))
    likely = has("license") | has("cc", "by")
    rows = rows.select("id", "text", F.lower("text").alias("small")).select("id", "text", "small", gate.alias("gate"), likely.alias("likely"))
    rows = rows.select(
        "id", "text", _words(text).alias("n_words"),
        F.when(F.col("likely") & text.rlike(phrase), F.regexp_extract_all(text, F.lit(phrase), F.lit(0))).alias("places"),
        F.when(F.col("gate"), _resolved(_found(text, small, rules))).otherwise(F.array().cast(none)).alias("kept"))
    rows = rows.select("id", "text", "n_words", "kept", "places", F.when(F.col("places").isNotNull(), F.split("text", phrase, -1)).alias("pieces"))
    here = F.col("places").isNotNull()
    pieces = F.col("pieces")
    rows = rows.select(
        "id", "n_words", "kept", F.char_length("text").alias("size"),
        F.when(here, F.size("places")).otherwise(0).cast("long").alias("n_base"),
        F.when(here, _words(F.get(pieces, F.lit(0)))).alias("first_word"),
        F.when(here, F.col("n_words") - _words(F.element_at(pieces, -1)) - _words(F.element_at("places", -1))).alias("last_word"),
        F.array_compact(F.array(*[F.when(here & _one_is("places", _phrase(p)), F.lit(label)) for p, label in PHRASES])).alias("base"))
    covered = F.aggregate("kept", F.lit(0), lambda acc, d: acc + d["stop"] - d["start"])
    return rows.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base").alias("base_labels"),
        F.array_sort(F.array_union("base", F.transform("kept", lambda d: d["label"]))).alias("labels"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["rank"].alias("rank"), d["label"].alias("label"))).alias("detections"),
        F.when(F.col("size") > 0, covered / F.col("size")).otherwise(F.lit(0.0)).alias("score"))
