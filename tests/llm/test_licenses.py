import random
import re

from foliant.llm.licenses import PHRASES, scan_licenses, signature_rules


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split(" ")
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_base_places_match_a_plain_scan(spark):
    rng = random.Random(11)
    parts = ["GNU", "general", "Public", "license", "LICENSE", "Apache", "cc", "BY", "by", "mit", "MIT", "x", "É", "K", "😀"]
    gaps = [" ", "-", ", ", "\n", "\x00", "_", "", "'"]
    texts = [None, "", "cc by", "cc by cc by", "GNU General Public License's", "mit license mit license apache license"]
    texts += ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    rows = [(i // 2, t, "x") for i, t in enumerate(texts)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string").coalesce(1)).collect()
    assert [r["id"] for r in got] == [r[0] for r in rows]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [plain(t) for t in texts]
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in got)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CASES = {
    "Licensed under the Apache License, Version 2.0.": ["apache-2.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
    "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0"],
    "Released under the MIT License.": ["mit"],
    "😀 SPDX-License-Identifier: LGPL-2.1-or-later": ["lgpl-2.1"],
    "see the GNU Lesser General Public License and the Mozilla Public License v2.0": ["lgpl", "mpl-2.0"],
    "All rights reserved. Placed in the public domain.": ["all-rights-reserved", "public-domain"],
    "GPLv3 or GPL-2.0": ["gpl-3.0", "gpl-2.0"],
    "nothing of the kind: permit licenses": [],
}


def test_rules_and_suppression(spark):
    got = scan_licenses(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")).collect()
    for r, (text, want) in zip(sorted(got), CASES.items()):
        assert [d["label"] for d in r["detections"]] == want, text
        for a, b in zip(r["detections"], r["detections"][1:]):
            assert a["stop"] <= b["start"]
    found = {r["id"]: r["detections"] for r in got}
    text = list(CASES)[0]
    assert text[found[0][0]["start"]:found[0][0]["stop"]] == "Licensed under the Apache License, Version 2.0"


def test_rules_are_ordered_and_many():
    rules = signature_rules()
    assert len(rules) > 200 and [r["rank"] for r in rules] == list(range(len(rules)))
    assert all(re.compile(r["regex"]) for r in rules)


def samples(parsed):
    """Texts that a parsed pattern matches: every alternative and optional part occurs in one of them."""
    choices = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            choices.append([chr(arg)])
        elif name == "IN":
            kind, value = arg[0] if str(arg[0][0]) != "NEGATE" else arg[1]
            choices.append([{"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "1"}.get(str(value), "x") if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else value[0])])
        elif name == "MAX_REPEAT":
            low, _, inner = arg
            choices.append([""] * (low == 0) + [x * max(1, low) for x in samples(inner)])
        elif name == "SUBPATTERN":
            choices.append(samples(arg[3]))
        elif name == "BRANCH":
            choices.append([x for part in arg[1] for x in samples(part)])
        else:
            assert name in ("ASSERT_NOT", "AT"), name
    first = [c[0] for c in choices]
    return ["".join(first)] + ["".join(first[:i] + [x] + first[i + 1:]) for i, c in enumerate(choices) for x in c[1:]]


def test_keywords_are_in_every_match():
    from re import _parser

    for rule in signature_rules():
        found = samples(_parser.parse(rule["regex"]))
        for text in (x.replace(" ", gap) for x in found for gap in (" ", "\n", "  ")):
            assert re.search(rule["regex"], text), (rule, text)
            assert all(part in text.lower() for part in rule["keyword"].split("+")), (rule, text)


WRAPPED = {
    "This is licensed under the GNU General\nPublic License, version 3.": ["gpl-3.0"],
    "the GNU Library General Public License": ["lgpl"],
    "Open  Software\nLicense 3.0; All rights\n  reserved.": ["osl-3.0", "all-rights-reserved"],
    "Open Data Commons Database License": ["odbl"],
    "Placed in the public\ndomain. Python\nSoftware Foundation License": ["public-domain", "psf"],
    "a Creative\nCommons Attribution-ShareAlike 4.0 International License": ["cc"],
    "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0\nInternational License": ["cc"],
    "licensed under CC\nBY-NC-SA 4.0, or the 3\nclause BSD license": ["cc-by-nc-sa-4.0", "bsd-3"],
}


def test_wrapped_names_are_found(spark):
    got = scan_licenses(spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")).collect()
    assert [[d["label"] for d in r["detections"]] for r in sorted(got)] == list(WRAPPED.values())


def plain_resolved(text, rules):
    found = [(m.start(), m.end(), r["rank"], r["label"]) for r in rules for m in re.finditer(r["regex"], text)]
    found = [d for d in found if not any(e is not d and e[0] <= d[0] and d[1] <= e[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]) for e in found)]
    taken = []
    for d in sorted(found, key=lambda d: (d[2], d[0])):
        if not any(e[0] < d[1] and d[0] < e[1] for e in taken):
            taken.append(d)
    return sorted(taken)


def test_overlaps_are_resolved_in_rule_order_against_what_holds(spark):
    rules = [{"rank": i, "label": f"l{i}", "keyword": "a", "regex": p} for i, p in enumerate(
        ("cc dd", "bb cc", "aa bb", "aa", "dd ee ff", "ff aa", "bb cc dd ee", "ee", "a+"))]
    rng = random.Random(4)
    texts = ["aa bb cc dd", "aa bb cc dd ee ff aa bb"] + [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "a"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts.append("aa bb cc dd ee " * 300)  # many times the block of a running sum
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=rules).collect()
    for r in got:
        assert [tuple(d) for d in r["detections"]] == (plain_resolved(texts[r["id"]], rules) if "a" in texts[r["id"]] else [])
