"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined on blocks and verified by Hamming distance."""

from __future__ import annotations

from itertools import combinations
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import connected_components, free_names, written

SEED = 42
SHINGLE = 4
MAX_BITS = 4
# Buckets of up to so many fingerprints are compared by a self-join, of up to MEDIUM_BUCKET in one
# vectorised step that returns a spanning forest, and larger ones by shared neighbours.
SMALL_BUCKET = 24
MEDIUM_BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text as a signed number; 0 for a text without words.

    ASCII letters are lower-cased and words end at ASCII white space, which is what
    the methods of ``bytes`` do.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    size = min(shingle, len(words))
    starts = ends - lengths + 1
    slices = map(slice, starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(piece, SEED) for piece in map(line.__getitem__, slices)), np.uint64,
                         len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the bits of a very long text are counted piece by piece
        part = hashes[at: at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long")


def block_masks(n_distinct: int, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks such that two fingerprints within ``max_bits`` agree on all bits of at least one.

    64 bits are cut into ``max_bits + k`` blocks; at least k of them are untouched.
    k grows with the number of fingerprints, so that unrelated ones seldom share a
    block. Every k gives the same pairs.
    """
    k = 2 if n_distinct < 1 << 21 else 3 if n_distinct < 1 << 26 else 4
    cuts = [round(i * 64 / (max_bits + k)) for i in range(max_bits + k + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, k)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def link_edges(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever the full set of links connects.

    Small buckets are compared pair by pair and medium ones (of bounded size) in one
    step. In a large one two fingerprints x, y are linked exactly if they share a
    neighbour: some v within half of ``max_bits`` of both. Each member lists its
    neighbours over the bits that vary in its bucket and is tied to the smallest
    member with the same neighbour. Members with a common neighbour are all within
    ``max_bits`` of each other, so no tie is false, the rows grow with the bucket and
    not with its square, and no bucket of unbounded size sits in one task.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    masks = [_signed(m) for m in block_masks(distinct.count(), max_bits)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    stats = keyed.groupBy("block", "key").agg(
        F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"),
        F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")).where("n > 1")
    stats = written(stats)
    # Two members: their difference is what varies.
    pairs = stats.where((F.col("n") == 2) & (F.bit_count("varying") <= max_bits)).select(F.col("low").alias("a"), F.col("high").alias("b"))
    members = written(keyed.join(stats.where("n > 2").select("block", "key", "n", "varying"), ["block", "key"]))
    small = members.where(F.col("n") <= SMALL_BUCKET)
    left, right = small.select("block", "key", F.col("fp").alias("a")), small.select("block", "key", F.col("fp").alias("b"))
    close = left.join(right, ["block", "key"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    medium = members.where((F.col("n") > SMALL_BUCKET) & (F.col("n") <= MEDIUM_BUCKET)).select("block", "key", "fp")
    forest = medium.groupBy("block", "key").applyInPandas(lambda part: _forest(part, max_bits), "a long, b long")
    large = members.where(F.col("n") > MEDIUM_BUCKET)
    near = large.select("fp", "block", "key", F.explode(_neighbours(F.col("fp"), F.col("varying"), max_bits // 2)).alias("v"))
    tied = near.groupBy("block", "key", "v").agg(F.min("fp").alias("a"))
    ties = near.join(tied, ["block", "key", "v"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(close).union(forest).union(ties).distinct()


def _forest(part: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Ties each fingerprint of a bounded bucket to the smallest one it reaches in it."""
    prints = np.sort(part["fp"].to_numpy(np.int64)).view(np.uint64)
    linked = np.empty((len(prints), len(prints)), bool)
    for at in range(0, len(prints), 64):
        linked[at: at + 64] = np.bitwise_count(prints[at: at + 64, None] ^ prints[None, :]) <= max_bits
    label, before = np.arange(len(prints), dtype=np.int32), None
    while before is None or (label != before).any():
        before = label
        label = np.concatenate([np.where(linked[at: at + 64], label[None, :], len(prints)).min(axis=1)
                                for at in range(0, len(prints), 64)]).astype(np.int32)
        label = label[label]
    values = prints.view(np.int64)
    own = label != np.arange(len(prints))
    return pd.DataFrame({"a": values[label[own]], "b": values[own]})


def _neighbours(fp: F.Column, varying: F.Column, depth: int) -> F.Column:
    """Every value that differs from ``fp`` in at most ``depth`` of the varying bits."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
                    lambda bit: bit.bitwiseAND(varying) != 0)
    flips = F.array(F.lit(0).cast("long"))
    for _ in range(depth):
        flips = F.array_distinct(F.flatten(F.transform(flips, lambda f: F.concat(F.array(f), F.transform(bits, lambda bit: f.bitwiseOR(bit))))))
    return F.transform(flips, lambda f: fp.bitwiseXOR(f))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
                    shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component) of every row: rows reach each other through fingerprints ``max_bits`` or fewer bits apart.

    Texts of fewer words than a shingle are hashed whole; null, empty and blank texts
    have fingerprint 0 and link like any other. Rows with the same id keep a row each.
    A null id is kept and never names a component that has other ids. An empty table
    gives an empty result.
    """
    prints = written(with_fingerprint(docs, id_col, text_col, shingle))
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")))
    linked = connected_components(link_edges(distinct.select("fp"), max_bits))
    held = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    smallest = held.groupBy("root").agg(F.min("first").alias("component"))
    named = held.join(smallest, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: the one with the smallest id.

    Of rows equal in id and fingerprint one stays. A null id counts as the largest.
    Only ids move, not texts, except for ids that several rows have.
    """
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, max_bits, shingle), lambda text: fingerprint(text, shingle), id_col, text_col)


def first_of_each(docs: DataFrame, groups: DataFrame, print_of_text: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that come first, by id and then by fingerprint, in their component of ``groups`` (id, fp, component)."""
    last = F.lit((1 << 63) - 1)
    key, own_print, best_print = free_names(docs.columns, "_id", "_fp", "_best")
    found = written(groups.select(F.coalesce("id", last).alias(key), F.col("fp").alias(own_print), "component"))
    best = found.groupBy("component").agg(F.min(F.struct(key, own_print)).alias("best")).select("best.*")
    rows = found.groupBy(key).agg(F.count("*").alias("n"))
    several = rows.where("n > 1").select(key)
    gone = rows.join(best.select(key).distinct(), key, "left_anti").select(key).union(several).distinct()
    own = F.coalesce(F.col(id_col).cast("long"), last)
    kept = docs.join(gone, own == F.col(key), "left_anti")
    again = best.join(several, key, "left_semi")
    if again.isEmpty():
        return kept
    # Ids that several rows have: the fingerprint tells the rows apart.
    print_of = F.pandas_udf(lambda texts: pd.Series([print_of_text(t) for t in texts], dtype="int64"), "long")
    tried = docs.join(again.select(key).distinct(), own == F.col(key), "left_semi").select("*", own.alias(key), print_of(F.col(text_col)).alias(own_print))
    chosen = tried.join(again.withColumnRenamed(own_print, best_print), key).where(F.col(own_print) == F.col(best_print))
    return kept.union(chosen.dropDuplicates([key, own_print]).select(docs.columns))
