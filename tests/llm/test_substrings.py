import random
from collections import Counter

import pytest

from foliant.llm.shared import text_key
from foliant.llm.substrings import repeated_passages
from pyspark.sql import functions as F


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("group_names, batch_bytes", [(2_000_000, 8 << 20), (40, 600)])
def test_matches_brute_force(spark, group_names, batch_bytes):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(14)]
    texts = [None, "", "  ", "one", "x " * 50, "x " * 9]
    for i in range(60):
        words = [rng.choice(["The", "of", "É", "a", f"w{rng.randint(0, 500)}"]) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        texts.append("\n".join([" ".join(words[:20]), "\t".join(words[20:])]))
    texts += [texts[10]] * 5 + [" " + texts[11]]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    found = repeated_passages(docs, window=10, prefixes=(2, 4, 8), group_names=group_names, batch_bytes=batch_bytes)
    got = docs.select("doc_id", *text_key(F.coalesce("text", F.lit("")))).join(found, ["k1", "k2"]).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == plain(texts, 10)
    assert all(sum(b - a for a, b in r["repeats"]) == r["n_removed"] for r in got)


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
