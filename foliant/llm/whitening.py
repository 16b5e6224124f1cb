"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers, so that the scatter matrix of the different ones is known
exactly. Its characteristic polynomial is computed modulo one prime a row of a Spark
job (Hessenberg form, then the recurrence of its leading minors) and put together by
Chinese remaindering. All its roots are real, so the sign changes of the shifted
polynomial count the roots above a point exactly: bisection isolates the largest
ones, and the polynomial's sign refines them to many digits. Inverse iteration with
such a root as shift gives the null space, and so the component, in one task each.
The driver holds numbers by dimension only: sums, residues, roots and components.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import reduce
from math import comb, gcd
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import discard, new_path, written
from foliant.llm.vectors import _vectors

SCALE = 256
COMPONENTS = 4
ROWS = 4096
LIMB = 40  # bits of a part of a sum; four parts hold every sum of products
ROOT_BITS = 160  # binary digits of a root below the trace's first one
ALIKE_BITS = 100  # roots that agree so far share a null space
DIGITS = 120


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, so that equal rows are equal bytes."""
    reach = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in (("<i1", -1, 1 << 7), ("<i2", 1 << 7, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, None)):
        rows = np.flatnonzero((reach >= low) & (reach < high if high else True))
        for i, row in zip(rows.tolist(), x[rows].astype(kind)):
            out[i] = row.tobytes()
    return out


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length and width among the columns size and x."""
    size = batch.column("size").to_numpy()
    raw = batch.column("x").to_pylist()
    width = np.fromiter(map(len, raw), np.int64, len(raw)) // np.maximum(size, 1)
    for n in np.unique(size).tolist():
        for w in np.unique(width[size == n]).tolist():
            rows = np.flatnonzero((size == n) & (width == w))
            yield rows, np.frombuffer(b"".join(raw[i] for i in rows), f"<i{w}").reshape(-1, n).astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, size, x): ``floor(scale * c)`` of every entry, for rows whose entries are all finite and fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in _vectors(batch.column(1)):
                with np.errstate(all="ignore"):
                    whole = np.floor(scale * c)
                    good = (np.abs(whole) < 2.0 ** 63).all(axis=1)  # false for nan and infinity too
                rows, whole = rows[good], whole[good]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), whole.shape[1], np.int32)),
                                                      pa.array(_packed(whole.astype(np.int64)), pa.binary())], names=["id", "size", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        run, "id long, size int, x binary")


def _products(x: np.ndarray) -> np.ndarray:
    """The exact sum of outer products of the rows."""
    most = max(int(x.max()), -int(x.min()))
    if most * most * len(x) < 1 << 53:  # whole numbers that doubles hold
        return (x.astype(np.float64).T @ x.astype(np.float64)).astype(np.int64).astype(object)
    big = x.astype(object)
    return big.T @ big


def scatter(distinct: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length of vector: how many rows, the sums by dimension and n times the scatter about the mean, all exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _unpacked(batch):
                n = x.shape[1]
                for at in range(0, len(x), ROWS):
                    part = x[at: at + ROWS]
                    sums = held.setdefault(n, [0, 0, 0])
                    sums[0] += len(part)
                    sums[1] = sums[1] + part.astype(object).sum(axis=0)
                    sums[2] = sums[2] + _products(part)
        for n, (count, sums, products) in held.items():
            place = [(-1, -1, count), *((-1, j, v) for j, v in enumerate(sums)), *((i, j, products[i, j]) for i in range(n) for j in range(i, n))]
            values = [int(v) for _, _, v in place]
            limbs = [[v >> LIMB * k & (1 << LIMB) - 1 if k < 3 else v >> LIMB * k for v in values] for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(place), pa.int32()), *[pa.array([p[k] for p in place], pa.int32()) for k in (0, 1)],
                                              *[pa.array(limb, pa.int64()) for limb in limbs]], names=["size", "i", "j", "l0", "l1", "l2", "l3"])

    parts = distinct.mapInArrow(run, "size int, i int, j int, l0 long, l1 long, l2 long, l3 long")
    out: dict[int, dict] = {}
    for r in parts.groupBy("size", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)]).collect():  # by dimension only
        out.setdefault(r["size"], {})[r["i"], r["j"]] = sum(r[f"l{k}"] << LIMB * k for k in range(4))
    found = {}
    for n, v in out.items():
        count, sums = v[-1, -1], [v[-1, j] for j in range(n)]
        found[n] = count, sums, [[count * v[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(n)] for i in range(n)]
    return found


def _is_prime(n: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: float) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    out, n = [], 2 ** 31 - 1
    while 30 * len(out) <= bits:
        if _is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, from the constant one on, of the characteristic polynomial modulo a prime below 2^31."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    n = len(h)
    for k in range(n - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        if (r := k + 1 + int(rows[0])) != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    minors = np.zeros((n + 1, n + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, n + 1):
        line = -int(h[k - 1, k - 1]) * minors[k - 1] % p
        line[1:] += minors[k - 1, :-1]
        below, weights = 1, np.zeros(k - 1, np.int64)
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            weights[i - 1] = int(h[i - 1, k - 1]) * below % p
        minors[k] = (line - (weights[:, None] * minors[: k - 1] % p).sum(axis=0)) % p
    return minors[n].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the constant one on, for a symmetric integer matrix without negative eigenvalues."""
    n, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # Those of (1 + trace / n)^n bound them all; one more bit is for the sign.
    limit = 2 * sum(comb(n, k) * (trace // n + 1) ** k for k in range(n + 1))
    moduli = primes(limit.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([polynomial_modulo(matrix, p)], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(moduli), 1, tasks).select(F.element_at(F.array(*map(F.lit, moduli)), F.col("id").cast("int") + 1).cast("long").alias("p"))
    values, whole = [0] * (n + 1), 1
    for r in rows.mapInArrow(run, "p long, c array<long>").collect():  # a row for each prime
        p = r["p"]
        inverse = pow(whole, -1, p)
        values = [v + whole * ((c - v) * inverse % p) for v, c in zip(values, r["c"])]
        whole *= p
    return [v - whole if 2 * v > whole else v for v in values]


def _scaled(c: list[int], s: int) -> list[int]:
    """The polynomial whose roots are 2^s times as large."""
    n = len(c) - 1
    return [v << s * (n - i) for i, v in enumerate(c)]


def roots_above(c: list[int], a: int) -> int:
    """How many roots, each as often as it counts, are above ``a``, if all are real: sign changes of the shifted polynomial."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(c: list[int], a: int) -> int:
    return reduce(lambda acc, v: acc * a + v, reversed(c), 0)


def kth_root(c: list[int], k: int, trace: int) -> tuple[int, int]:
    """(a, s): the k-th largest root is in (a / 2^s, (a + 1) / 2^s], where s is such that this is a tiny part of ``trace``."""
    low, high, alone = -1, trace, False  # no root is negative, none above the trace
    last = max(1, ROOT_BITS - trace.bit_length())
    s = 0
    above_low, above_high = len(c) - 1, 0
    part = c
    while True:
        while high - low > 1:
            mid = (low + high) // 2
            if alone:  # one simple root between: the sign tells on which side of mid it is
                value = _value(part, mid)
                above = k if value and (value > 0) != positive else k - 1
            else:
                above = roots_above(part, mid)
            if above >= k:
                low, above_low = mid, above
            else:
                high, above_high = mid, above
            if not alone and above_low == k and above_high == k - 1 and (value := _value(part, high)):
                alone, positive = True, value > 0
        if s >= last:
            return low, s
        s, low, high = s + 1, 2 * low, 2 * high
        part = _scaled(c, s)


def null_vector(matrix: list[list[int]], root: Decimal, others: list[list[Decimal]]) -> list[Decimal]:
    """A unit vector that the matrix less ``root`` maps to next to nothing, at right angles to ``others`` of the same root."""
    n = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        size = max(1, max(abs(v) for row in matrix for v in row))
        tiny = Decimal(size) * Decimal(10) ** (20 - DIGITS)
        a = [[Decimal(v) - root if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        order, factors = list(range(n)), []
        for k in range(n):
            r = max(range(k, n), key=lambda i: abs(a[i][k]))
            a[k], a[r], order[k], order[r] = a[r], a[k], order[r], order[k]
            if factors:
                factors[k], factors[r] = factors[r], factors[k]
            else:
                factors = [[] for _ in range(n)]
                factors[k], factors[r] = factors[r], factors[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            top, pivot = a[k], a[k][k]
            for i in range(k + 1, n):
                f = a[i][k] / pivot
                factors[i].append(f)
                if f:
                    row = a[i]
                    for j in range(k + 1, n):
                        row[j] -= f * top[j]

        def apart(v: list[Decimal]) -> list[Decimal]:
            for o in others:
                along = sum((x * y for x, y in zip(v, o)), Decimal(0))
                v = [x - along * y for x, y in zip(v, o)]
            length = sum((x * x for x in v), Decimal(0)).sqrt()
            return [x / length for x in v]

        rng = random.Random(len(others))
        v = apart([Decimal(rng.randint(1, 1 << 30)) for _ in range(n)])
        for _ in range(3):
            y = [v[i] for i in order]
            for i in range(n):
                y[i] -= sum((f * y[j] for j, f in enumerate(factors[i])), Decimal(0))
            for i in range(n - 1, -1, -1):
                y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, n)), Decimal(0))) / a[i][i]
            v = apart(y)
        top = max(v, key=abs)
        return [x if top > 0 else -x for x in v]


@dataclass
class Whitening:
    """What rows of one length need: their number and sums, and by component eigenvalue, share of the trace and direction."""

    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    directions: np.ndarray


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model for each length of vector among ``distinct`` rows (size, x). Directions without variance are no components."""
    spark = distinct.sparkSession
    out = {}
    for size, (n, sums, matrix) in scatter(distinct).items():
        common = gcd(*(v for row in matrix for v in row))
        if not common:  # one different vector only
            out[size] = Whitening(n, sums, [], [], np.zeros((0, size)))
            continue
        matrix = [[v // common for v in row] for row in matrix]
        trace = sum(matrix[i][i] for i in range(size))
        c = characteristic_polynomial(spark, matrix)
        wanted = min(components, roots_above(c, 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    low, s = kth_root(c, k, trace)
                    with localcontext() as context:
                        context.prec = DIGITS
                        root = Decimal(2 * low + 1) / Decimal(2 ** (s + 1))
                        near = Decimal(trace) / Decimal(2 ** ALIKE_BITS)
                        above = root + near
                        edge = int(above * 2 ** s)
                    # Roots that agree this far are one root: its earlier components come first, each at right angles to those before.
                    before = roots_above(_scaled(c, s), edge)
                    basis: list[list[Decimal]] = []
                    while len(basis) < k - before:
                        basis.append(null_vector(matrix, root, basis))
                    with localcontext() as context:
                        context.prec = DIGITS
                        value, share = float(root * common / (n * n)), float(root / trace)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value]), pa.array([share]), pa.array([[float(x) for x in basis[-1]]])],
                                                     names=["k", "value", "share", "direction"])

        found = sorted(spark.range(1, wanted + 1, 1, wanted).mapInArrow(run, "k int, value double, share double, direction array<double>").collect())
        out[size] = Whitening(n, sums, [r["value"] for r in found], [r["share"] for r in found], np.array([r["direction"] for r in found]))
    return out


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    """(rows, components): projections of the centred rows over the square roots of the eigenvalues."""
    if not _fits(model, x):
        away = (x.astype(object) * model.n - np.array(model.sums, object)).astype(np.float64)
    else:
        away = (x * model.n - np.array(model.sums, np.int64)).astype(np.float64)
    return away / model.n @ model.directions.T / np.sqrt(model.values)


def _fits(model: Whitening, x: np.ndarray) -> bool:
    """Whether sums of squares of n * x - sums stay within a long."""
    most = max(int(x.max()), -int(x.min()), 1) * model.n + max(map(abs, model.sums))
    return most * most * x.shape[1] < 1 << 63


def _deviations(model: Whitening, x: np.ndarray) -> list[int]:
    """The exact sum over the dimensions of (n * x - sums)^2, for each row."""
    away = x.astype(np.int64 if _fits(model, x) else object) * model.n - np.array(model.sums, np.int64 if _fits(model, x) else object)
    return [int(v) for v in (away * away).sum(axis=1)]


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
                     scale: int = SCALE) -> DataFrame:
    """(id, size, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null or empty or hold null or non-finite entries, or entries
    whose ``scale``-fold does not fit a long, are dropped. The fit takes each different
    integer vector once, so copies do not change it; rows with the same id or vector
    keep rows of their own, null ids too. Vectors of each length are fitted by
    themselves. A component needs variance: there are as many as the rank, at most
    ``components``, so vectors that are all the same have no rows; neither has an empty
    table. Of equal eigenvalues any orthonormal basis is taken, the same for all rows.
    ``deviation`` is a decimal(38, 0), exact, and null beyond that.
    """
    spark, path = vectors.sparkSession, new_path(vectors.sparkSession)
    rows = written(integers(vectors, id_col, vector_col, scale))
    distinct = written(rows.select("size", "x").distinct(), path)
    models = {size: model for size, model in fit(distinct, components).items() if model.values}
    most = max((len(m.values) for m in models.values()), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _unpacked(batch):
                if (model := models.get(x.shape[1])) is not None:
                    w = _whitened(model, x)
                    columns = [pa.array(w[:, k]) if k < w.shape[1] else pa.nulls(len(w), pa.float64()) for k in range(most)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), x.shape[1], np.int32)), *columns], names=["size", *(f"w{k}" for k in range(most))])

    errors: dict[int, float] = {}
    if models:
        pairs = [(i, j) for i in range(most) for j in range(i, most)]
        held = distinct.mapInArrow(project, "size int" + "".join(f", w{k} double" for k in range(most)))
        for r in held.groupBy("size").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect():  # a row for each length
            errors[r["size"]] = max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(models[r["size"]].values))
    discard(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "size", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for picked, x in _unpacked(batch):
                if (model := models.get(x.shape[1])) is None:
                    continue
                k, w = len(model.values), _whitened(model, x)
                deviation = [v if v < 10 ** 38 else None for v in _deviations(model, x)]
                total = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(picked, k))), pa.array(np.full(total, x.shape[1], np.int32)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(total, model.n, np.int64)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w.ravel()),
                    pa.array(np.tile(model.explained, len(x))), pa.array(np.full(total, errors[x.shape[1]]))], names=names)

    return rows.mapInArrow(run, "id long, size int, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double")
