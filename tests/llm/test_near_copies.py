import random

import numpy as np

from foliant.llm.near_copies import _common, _ties, band_keys, keep_one, near_copies, prefix, shingles


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(texts):
    """Group of each text, by comparing all pairs exactly."""
    sets = [plain_shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def fixture():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one two", "One  two", "one two three"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for at in rng.sample(range(len(other)), rng.randint(1, 1 + len(other) // 40)):
                other[at] = rng.choice(words)
            texts.append(" ".join(other))
    base = [rng.choice(words) for _ in range(100)]
    for _ in range(60):  # a family at about the threshold, in which no member is close to all others
        other = list(base)
        for at in rng.sample(range(100), 1 + (rng.random() < 0.5)):
            other[at] = rng.choice(words)
        texts.append(" ".join(other))
    return texts


def partition(pairs):
    out = {}
    for i, g in pairs:
        out.setdefault(g, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_groups_are_those_of_all_pairs(spark):
    texts = fixture()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = partition(enumerate(plain(texts)))
    assert any(len(g) > 1 for g in want[3:]) and len(want) > 20
    assert partition((r["id"], r["component"]) for r in near_copies(docs).collect()) == want
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted(g[0] for g in want)
    for limits in ({"rows": 4}, {"rows": 3, "shingles_": 500}):  # buckets cut into many tiles
        assert partition((r["id"], r["component"]) for r in near_copies(docs, **limits).collect()) == want
    assert near_copies(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_tiles_find_all_pairs_of_a_family_without_a_centre():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 90).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(90) < 0.05, rng.integers(0, 1 << 62, 90).astype(np.uint64), base)) for _ in range(120)] + [np.empty(0, np.uint64)]
    common = _common(sets[:50], sets[50:])
    assert common.tolist() == [[len(np.intersect1d(a, b)) for b in sets[50:]] for a in sets[:50]]
    names = np.arange(len(sets))
    for side in (np.zeros(len(sets), int), (names % 3 == 0).astype(int)):
        want = list(names)
        for i in names:
            for j in names[:i]:
                both = len(np.intersect1d(sets[i], sets[j]))
                if (side[i] != side[j] or not side.any()) and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    want = [want[j] if g == want[i] else g for g in want]
        got = list(names)
        for a, b in zip(*_ties(names, sets, side)):
            got = [got[a] if g == got[b] else g for g in got]
        assert len(set(want)) < 100 and partition(enumerate(got)) == partition(enumerate(want))


def test_columns_may_have_any_names_and_ids_repeat(spark):
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (1, "other words are here now ok", 2, "y"), (None, "a b c d e f", 3, "z"), (4, None, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _fp string").selectExpr(
        "*", "1 as component", "2 as k1", "3 as bytes", "4 as _best", "5 as _text", "6 as key")
    got = sorted(map(str, keep_one(docs).select(docs.columns).collect()))
    want = sorted(map(str, docs.dropDuplicates().where("doc_id is not null").collect()))
    assert got == want


def test_pipeline_stage_finds_copies_that_four_bits_miss(spark):
    import corpus_pipeline

    from foliant.llm import simhash

    texts = fixture()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(g[0] for g in partition(enumerate(plain(texts))))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert simhash.keep_one(docs).count() > len(want)


# Thirteen words of fourteen: 8 of 10 shingles are common, and no band.
LOST = "w2926 w101 w1881 w2124 w576 w3819 w2189 w759 w827 w147 w2523 w466 w121 w3185".split()


def test_copies_without_a_common_band_are_found(spark):
    a, b = " ".join(LOST[:-1]), " ".join(LOST[1:])
    assert not set(band_keys(shingles(a))) & set(band_keys(shingles(b))) and plain([a, b]) == [0, 0]
    others = [f"{a} x{i} y{i} z{i} u{i} v{i}" for i in range(80)]  # farther ones, which make their shingles frequent
    for texts in ([a, b], [a, b, *others]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        assert partition((r["id"], r["component"]) for r in near_copies(docs).collect()) == partition(enumerate(plain(texts)))


def test_near_copies_share_shingles_of_their_prefixes():
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 5, 9, 30, 300):
        for _ in range(40):
            base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            common = base[rng.random(n) < 0.95]
            sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n // 10).astype(np.uint64)])) for _ in range(2)]
            both = len(np.intersect1d(*sets))
            if both and 5 * both >= 4 * (len(sets[0]) + len(sets[1]) - both):
                names = np.unique(base[: n // 2] >> np.uint64(23))
                for order in ((names, rng.integers(4, 9, len(names))), (names[:0], names[:0])):
                    assert len(np.intersect1d(*[prefix(s, *order) for s in sets])) >= min(4, -(-4 * max(map(len, sets)) // 5))
