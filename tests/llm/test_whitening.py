from decimal import Decimal

import numpy as np
import pytest

from foliant.llm import whitening as W

SHAPE = "vec_id long, embedding array<float>, size int, x string"


def plain(rows):
    """The contract by numpy: rows, n, deviations, and eigenpairs of the covariance of the different integer vectors."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    values, directions = np.linalg.eigh((fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / len(fit))
    return good, fit, values[::-1], directions[:, ::-1]


def check(spark, rows, components=4):
    got = W.whitened_vectors(spark.createDataFrame([(i, v, 3, "y") for i, v in rows], SHAPE).repartition(3)).collect()
    good, fit, values, directions = plain(rows)
    n, sums = len(fit), fit.sum(axis=0).astype(int).tolist()
    rank = int((values > 1e-9 * values[0]).sum())
    k = min(components, rank)
    assert len(got) == len(good) * k
    want = {}
    for i, x in good:
        want.setdefault(str(i), []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - fit.mean(axis=0)) @ directions / np.sqrt(np.abs(values) + 1e-300)))
    for c in range(k):
        column = sorted((str(r["id"]), int(r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1)
        for sign in (1, -1):
            expected = sorted((i, d, sign * w[c]) for i, all_ in want.items() for d, w in all_)
            if np.allclose([x[2] for x in column], [x[2] for x in expected], atol=1e-6):
                assert [x[:2] for x in column] == [x[:2] for x in expected]
                break
        else:
            raise AssertionError(f"component {c + 1}")
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9


def test_rows_equal_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 12)) * np.linspace(2, 0.3, 12) + rng.standard_normal(12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [3e38] + [0.0] * 11)]
    rows += [(1000 + i, rows[5][1]) for i in range(100)]
    dropped = {904}  # too large for a long
    got = W.whitened_vectors(spark.createDataFrame([(i, v, 3, "y") for i, v in rows], SHAPE)).select("id").distinct().collect()
    assert not {900, 901, 902, 903, 904} & {r["id"] for r in got}
    check(spark, [r for r in rows if r[0] not in dropped])


def test_few_ranks_equal_rows_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    low = rng.standard_normal((40, 2)) @ rng.integers(-2, 3, (2, 6))
    flat = [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 3), (0, -3)])]
    check(spark, flat)
    frame = spark.createDataFrame([(i, v.tolist(), 1, "") for i, v in enumerate(low)], SHAPE)
    assert frame.count() * 4 == W.whitened_vectors(frame).count()  # rounding makes the rank full
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "") for i in range(5)], SHAPE)
    assert W.whitened_vectors(same).count() == 0 and W.whitened_vectors(same.limit(0)).count() == 0
    mixed = spark.createDataFrame([(i, v[: 3 + i % 2].tolist(), 1, "") for i, v in enumerate(low)], SHAPE)
    assert {(r["size"], r["n"]) for r in W.whitened_vectors(mixed).collect()} == {(3, 20), (4, 20)}


def test_equal_eigenvalues_have_a_basis(spark):
    rows = [(4 * i + s, [float(3 * t * (j == i)) for j in range(4)]) for i in range(4) for s, t in enumerate((1, -1))]
    got = W.whitened_vectors(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SHAPE)).collect()
    assert len(got) == 32 and all(r["identity_error"] < 1e-12 and abs(r["explained"] - 0.25) < 1e-15 for r in got)


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_polynomial_and_roots_are_exact(spark, n):
    rng = np.random.default_rng(n)
    a = rng.integers(-10 ** 6, 10 ** 6, (n + 2, n)).astype(object)
    matrix = (a.T @ a).tolist()
    c = W.characteristic_polynomial(spark, matrix)
    plain_c, m = [1], [[0] * n for _ in range(n)]  # Faddeev and LeVerrier
    for k in range(1, n + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(n)) + (plain_c[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        plain_c.append(-sum(sum(matrix[i][l] * m[l][i] for l in range(n)) for i in range(n)) // k)
    assert c == plain_c[::-1]
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    trace = sum(matrix[i][i] for i in range(n))
    for k in range(1, n + 1):
        low, s = W.kth_root(c, k, trace)
        assert abs(float(Decimal(low) / Decimal(2 ** s)) / values[k - 1] - 1) < 1e-6
        assert W.roots_above(W._scaled(c, s), low) >= k > W.roots_above(W._scaled(c, s), low + 1)


def test_sums_beyond_a_long_are_exact(spark):
    x = [[2 ** 61 - 3, -(2 ** 60)], [5, 2 ** 62], [-(2 ** 62), 17]]
    packed = spark.createDataFrame([(2, bytearray(np.array(v, "<i8").tobytes())) for v in x], "size int, x binary").repartition(2)
    n, sums, matrix = W.scatter(packed)[2]
    assert (n, sums) == (3, [sum(v[j] for v in x) for j in range(2)])
    assert matrix == [[3 * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(2)] for i in range(2)]
    assert W._packed(np.array([[127, -128], [128, 0], [-32769, 1], [2 ** 31, 0]])) == [
        np.array(v, k).tobytes() for v, k in (([127, -128], "<i1"), ([128, 0], "<i2"), ([-32769, 1], "<i4"), ([2 ** 31, 0], "<i8"))]
