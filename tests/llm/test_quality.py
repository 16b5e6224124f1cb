import random

from foliant.llm.quality import keep_good, score_documents


def fixture(n=300):
    rng = random.Random(10)
    docs, labels, truth = [], [], {}
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "of", "river", "stone", "light", "and", "old", "wind"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 90))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words[:8] * 5)
        docs.append((i, text, "en", "good.example" if good or rng.random() < 0.3 else "bad.example", len(text), 1))
        truth[i] = good
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return docs, labels, truth


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, keep int"


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, truth = fixture()
    odd = [(900, None, None, None, None, 1), (901, "", "en", None, 0, 1), (None, "The old river of stone.", "en", "x", 23, 1), (5, docs[5][1], "en", "x", 9, 1)]
    frame = spark.createDataFrame(docs + odd, SHAPE).repartition(3)
    marks = spark.createDataFrame(labels + [(0, None, 0), (7777, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_documents(frame, marks).collect()
    assert len(got) == len(docs) + len(odd) and all(r["score"] is not None for r in got)
    held_out = [r for r in got if r["id"] in truth and r["id"] % 3 and r["id"] != 5]
    assert sum(r["keep"] == truth[r["id"]] for r in held_out) / len(held_out) > 0.97
    kept = keep_good(frame, marks)
    assert kept.columns == frame.columns
    want = sorted(str(r["id"]) for r in got if r["keep"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_nothing_to_learn(spark):
    docs, labels, _ = fixture(12)
    frame = spark.createDataFrame(docs, SHAPE)
    for marks in ([], [(0, 1, 0), (3, 1, 0)]):
        marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        got = score_documents(frame, marks).collect()
        assert len(got) == 12 and all(r["keep"] and r["score"] is None for r in got)
        assert keep_good(frame, marks).count() == 12
    assert score_documents(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_copies_count_with_their_own_metadata(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(80):  # the same texts from two sources, with a label each and with more copies that have none
        text = " ".join(rng.choice(["river", "stone", "light", "wind"]) for _ in range(30))
        for j in range(4):
            docs.append((4 * i + j, text, "en", ("good.example", "bad.example")[j % 2], 100, 1))
        labels += [(4 * i, 1, 0), (4 * i + 1, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = []
    for order in (docs, docs[::-1]):
        got = score_documents(spark.createDataFrame(order, SHAPE).repartition(3), marks).collect()
        runs.append({r["id"]: r["score"] for r in got})
        assert len(got) == len(docs) and all(r["keep"] == (r["id"] % 2 == 0) and abs(r["p_meta"] - (r["id"] % 2 == 0)) < 0.2 for r in got)
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-3 for i in runs[0])
