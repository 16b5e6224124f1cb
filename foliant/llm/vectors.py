"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. Rotated vectors are cut
into blocks of a few dimensions that share the allowed squared distance in
proportion to their variance; a close pair stays within the share in at least one
block. Each block is joined by range on a grid over its first coordinates, with
cells as wide as the share allows, so that only neighbouring cells meet. Cells are
cut into chunks of bounded size; a pair of chunks is one tile of work. In a tile
the block distances come first and survivors are verified in double precision.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import connected_components, written

THRESHOLD = 0.9
BLOCK = 16
GRID = 2  # coordinates of a block that its grid covers
CHUNK = 8192
ROWS = 512
SLACK = 1e-9


@lru_cache(8)
def _rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix, so that no block depends on how the dimensions are ordered."""
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def _blocks(size: int) -> list[slice]:
    return [slice(lo, min(lo + BLOCK, size)) for lo in range(0, size, BLOCK)]


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector; a missing component becomes nan."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        picked = column.take(pa.array(rows))
        yield rows, picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is divided out first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)


def _shares(classes: DataFrame) -> dict[int, list[float]]:
    """For each length of vector, the share of the squared distance that each block may use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                x = x[_usable(x)]
                if len(x):
                    x = _unit(x) @ _rotation(x.shape[1])
                    sums[x.shape[1]] = sums.get(x.shape[1], 0) + np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        rows = [(size, i, v) for size, values in sums.items() for i, v in enumerate(values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.float64())], names=["size", "i", "v"])

    parts = classes.select("vector").mapInArrow(run, "size int, i int, v double").groupBy("size", "i").agg(F.sum("v").alias("v"))
    found: dict[int, dict[int, float]] = {}
    for row in parts.collect():  # 2 * length + 1 rows for each length of vector
        found.setdefault(row["size"], {})[row["i"]] = row["v"]
    out = {}
    for size, v in found.items():
        variance = np.array([max(0.0, v[1 + size + i] / v[0] - (v[1 + i] / v[0]) ** 2) for i in range(size)])
        share = np.array([variance[b].sum() for b in _blocks(size)])
        share = share / share.sum() if share.sum() > 0 else np.ones(len(share))
        share = share + 0.05 / len(share)  # a block that hardly varies still gets a cell width
        out[size] = (share / share.sum()).tolist()
    return out


def _budgets(shares: list[float], threshold: float) -> np.ndarray:
    return (2 - 2 * threshold) * np.array(shares) * (1 + SLACK) + 1e-12


def _cells(shares: dict[int, list[float]], threshold: float, kind: str):
    """(cls, copies, size, vector as bytes, block, x, y) for each block of each usable vector."""
    names = ["cls", "copies", "size", "raw", "block", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column(2)):
                good = _usable(x)
                rows, x = rows[good], x[good]
                if not len(rows):
                    continue
                size = x.shape[1]
                turned = _unit(x) @ _rotation(size)
                raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                keep = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                for b, (block, budget) in enumerate(zip(_blocks(size), _budgets(shares[size], threshold))):
                    width = np.sqrt(budget) * (1 + 1e-6)
                    grid = np.floor(turned[:, block][:, :GRID] / width).astype(np.int64)
                    y = grid[:, 1] if grid.shape[1] > 1 else np.zeros(len(rows), np.int64)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(np.full(n, size, np.int32)), raw, pa.array(np.full(n, b, np.int32)),
                                                      pa.array(grid[:, 0]), pa.array(y)], names=names)

    return run, "cls long, copies long, size int, raw binary, block int, x long, y long"


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _lifted(a: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products with lifted rows of the other side are squared distances."""
    norm, one = (a * a).sum(axis=1)[:, None], np.ones((len(a), 1))
    return np.concatenate([a, norm, one] if left else [-2 * a, one, norm], axis=1).astype(np.float32)


def _tile(shares: dict[int, list[float]], threshold: float, kind: str):
    """Links between two chunks, or within one: for each vector how many, and the smallest vector it reaches in the tile."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        size, block = int(part["size"].iloc[0]), int(part["block"].iloc[0])
        budgets, cuts = _budgets(shares[size], threshold), _blocks(size)
        unit = _unit(np.frombuffer(b"".join(part["raw"]), kind).astype(np.float64).reshape(-1, size))
        turned = unit @ _rotation(size)
        side, ids, copies = part["side"].to_numpy(), part["cls"].to_numpy(), part["copies"].to_numpy()
        same = not (side == 1).any()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"cls": [], "links": [], "reach": []}).astype("int64")
        low, high = _lifted(turned[left][:, cuts[block]], True), _lifted(turned[right][:, cuts[block]], False)
        links, pairs = np.zeros(len(part), np.int64), []
        for at in range(0, len(left), ROWS):
            near = low[at: at + ROWS] @ high.T <= budgets[block] + 1e-5  # single precision, so with room for its error
            if same:
                near &= right[None, :] > left[at: at + ROWS, None]
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            some_right = np.flatnonzero(near.any(axis=0))
            rows, columns = left[at + some], right[some_right]
            linked = near[np.ix_(some, some_right)] & (unit[rows] @ unit[columns].T >= threshold)
            linked &= _squared(turned[rows][:, cuts[block]], turned[columns][:, cuts[block]]) <= budgets[block]
            for b in range(block):  # the first block that a pair is close in has it
                if not linked.any():
                    break
                linked &= _squared(turned[rows][:, cuts[b]], turned[columns][:, cuts[b]]) > budgets[b]
            links[rows] += linked @ copies[columns]
            links[columns] += copies[rows] @ linked
            pairs.append((rows, columns, np.packbits(linked, axis=1)))
        label, before = ids.copy(), None
        while before is None or (label != before).any():
            before = label.copy()
            for rows, columns, bits in pairs:
                linked = np.unpackbits(bits, axis=1, count=len(columns)).astype(bool)
                least = np.where(linked, label[columns][None, :], np.iinfo(np.int64).max).min(axis=1)
                label[rows] = np.minimum(label[rows], least)
                least = np.where(linked, label[rows][:, None], np.iinfo(np.int64).max).min(axis=0)
                label[columns] = np.minimum(label[columns], least)
        found = links > 0
        return pd.DataFrame({"cls": ids[found], "links": links[found], "reach": label[found]})

    return run


def _chunked(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the chunk of their cell, and all tiles (pairs of chunks in the same or neighbouring cells)."""
    where = ["size", "block", "x", "y"]
    splits = written(cells.groupBy(*where).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("splits")))
    rows = cells.join(splits, where).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("splits")).cast("int")).drop("splits")
    chunks = splits.select(*where, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("chunk"))
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x2"), (F.col("y") + j).alias("y2")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    reach = chunks.select(*where, "chunk", around.alias("to")).select(*where, "chunk", "to.x2", "to.y2")
    other = chunks.select("size", "block", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("chunk").alias("chunk2"))
    tiles = reach.join(other, ["size", "block", "x2", "y2"]).where(
        F.struct("x", "y", "chunk") <= F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("chunk2").alias("chunk")))
    return rows, tiles.withColumn("tile", F.monotonically_increasing_id())


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component) of every row: links are pairs of rows with cosine of at least ``threshold``.

    Equal vectors are one class: its rows link with each other and are compared with
    others once. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and vectors of different lengths never link. The
    component is the smallest id reachable; a row without links has its own. Ids may
    repeat or be null. An empty table gives no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(7), vector).alias("k2"), vector.alias("vector"))
    usable = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()))
    shares = _shares(classes)
    # Single-precision vectors travel as such; they are compared in double precision all the same.
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    run, shape = _cells(shares, threshold, kind)
    cells = written(classes.select("cls", "copies", "vector").mapInArrow(run, shape))
    chunked, tiles = _chunked(cells)
    tiles = written(tiles)
    key = ["size", "block", "x", "y", "chunk"]
    ones = chunked.join(tiles.select(*key, "tile"), key).withColumn("side", F.lit(0))
    twos = tiles.where("not (x = x2 and y = y2 and chunk = chunk2)").select(
        "size", "block", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("chunk2").alias("chunk"), "tile")
    twos = chunked.join(twos, key).withColumn("side", F.lit(1))
    # Tiles of one chunk have no second side; those of two whose second one is empty do not exist.
    columns = ["tile", "side", "cls", "copies", "size", "block", "raw"]
    found = written(ones.select(*columns).union(twos.select(*columns)).groupBy("tile").applyInPandas(
        _tile(shares, threshold, kind), "cls long, links long, reach long"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(found, "cls", "reach")
    held = classes.select("cls", "k1", "k2", "first", "copies").join(counts, "cls", "left").join(
        joined.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    least = held.groupBy("root").agg(F.min("first").alias("least"))
    named = held.join(least, "root").select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("id", "k1", "k2").where("usable").join(named, ["k1", "k2"]).select("id", F.col("links").alias("n_links"), F.col("least").alias("component"))
    return out.union(rows.where("not usable").select("id", F.lit(0).cast("long"), F.col("id")))
