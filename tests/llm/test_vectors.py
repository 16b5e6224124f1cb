import numpy as np
import pytest

from foliant.llm import vectors
from foliant.llm.vectors import linked_vectors


def plain(rows, threshold=0.9):
    usable = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if u else None for u, (_, v) in zip(usable, rows)]
    n = len(rows)
    links = [[j for j in range(n) if j != i and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    low, changed = [r[0] for r in rows], True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted((rows[i][0], len(links[i]), low[i]) for i in range(n))


@pytest.mark.parametrize("chunk, rows_at_once", [(8192, 512), (7, 5)])
def test_matches_brute_force(spark, monkeypatch, chunk, rows_at_once):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((6, 40))
    rows = []
    for i in range(150):
        v = centres[i % 6] + rng.standard_normal(40) * rng.choice([1e-12, 0.1, 0.4, 0.45, 3])
        rows.append((1000 - i, (v * rng.choice([1e-9, 1, 1e9])).tolist()))
    rows += [(5, rows[0][1]), (6, rows[0][1]), (6, rows[3][1]), (7, None), (8, []), (9, [0.0] * 40), (10, [None] + [1.0] * 39), (11, [float("nan")] * 40),
             (12, [float("inf")] + [0.0] * 39), (13, [1.0, 0.0]), (14, [2.0, 0.1]), (15, [3.0]), (16, [-3.0]), (17, [5.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cls int").repartition(3)
    got = sorted(tuple(r) for r in linked_vectors(frame).collect())
    assert got == plain(rows)


def test_one_dense_group_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 40)
    rng = np.random.default_rng(15)
    rows = [(i, (np.ones(20) + rng.standard_normal(20) * 0.2).astype(np.float32).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in linked_vectors(frame).collect()) == plain([(i, np.array(v, np.float32).tolist()) for i, v in rows])
    assert linked_vectors(frame.limit(0)).count() == 0
