"""Substring dedup over prefix-partitioned suffix trees.

A suffix is the run of words from one position to the end of its document. Two
passages of ``window`` words are the same exactly if their suffixes pass through
the same node at that depth, so each tree is built down to that depth only:

1. The sizes of all prefixes are counted in a sketch of fixed size, and the prefix
   that places a suffix is made longer (8, 16, 24 words, then the whole window)
   until its group of suffixes fits in memory.
2. Each batch of documents sends the nodes of its suffixes to their groups, a
   64-bit name for each, once for each batch however often it passes there.
3. A group sorts its names. Nodes that more than one suffix passes through are the
   deep internal nodes; the batch learns which of its nodes these are as one bit
   for each, in the order it sent them.
4. Runs of repeated nodes are the maximal repeats of a document.

Names stand for the words on the path from the root, so the trees cost eight bytes
a suffix and not ``window`` words. The nodes above the last one on a path carry
nothing that the result needs and are not stored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import empty_if_null, text_key

WINDOW = 35
PREFIXES = (8, 16, 24)
SLOT_BITS = 14
BATCH_BYTES = 8 << 20
GROUP_NAMES = 2_000_000

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps)
    return held


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Suffixes:
    """The suffixes of some documents that are at least ``window`` words long, and the names of their prefixes."""

    def __init__(self, documents: list[list[bytes]], window: int):
        self.lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        total = int(self.lengths.sum())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for words in documents for w in words), np.uint64, total)
        self.sums = np.zeros(total + 1, np.uint64)
        np.cumsum(hashes * _power(_BASE, total)[:total], out=self.sums[1:])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.counts = np.maximum(self.lengths - window + 1, 0)  # suffixes of each document
        first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        self.starts = np.arange(int(self.counts.sum())) + np.repeat(self.offsets[:-1] - first, self.counts)
        self.shift = _power(_INVERSE, total)[self.starts]

    def names(self, depth: int, picked: np.ndarray | slice = slice(None)) -> np.ndarray:
        starts = self.starts[picked]
        return _mixed((self.sums[starts + depth] - self.sums[starts]) * self.shift[picked])


def _slot(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_prefixes(docs: DataFrame, window: int, prefixes: tuple[int, ...]) -> tuple[int, np.ndarray]:
    """Suffixes in all, and a count for each prefix length and hash slot; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(prefixes), 1 << SLOT_BITS), np.int64)

        def add(held):
            found = Suffixes(held, window)
            for i, depth in enumerate(prefixes):
                sums[i] += np.bincount(_slot(found.names(depth)), minlength=1 << SLOT_BITS)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(words_of(text.as_py()))
                size += len(held[-1])
                if size > 500_000:
                    add(held)
                    held, size = [], 0
        add(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(prefixes)), pa.int32()),
                                          pa.array([row.tobytes() for row in sums], pa.binary())], names=["level", "counts"])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(x, np.int64) for x in part["counts"])
        return pd.DataFrame({"level": part["level"][:1], "spread": part["spread"][:1] * 0, "counts": [sums.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "level int, counts binary").withColumn("spread", F.spark_partition_id() % 64)
    shape = "level int, spread int, counts binary"
    summed = parts.groupBy("level", "spread").applyInPandas(total, shape).groupBy("level").applyInPandas(total, shape)
    table = np.zeros((len(prefixes), 1 << SLOT_BITS), np.int64)
    for row in summed.collect():  # one row for each prefix length
        table[row["level"]] = np.frombuffer(row["counts"], np.int64)
    return int(table[0].sum()), table


class Placement:
    """Which group a suffix belongs to: by its shortest prefix that few enough suffixes share."""

    def __init__(self, total: int, counts: np.ndarray, window: int, prefixes: tuple[int, ...], group_names: int):
        self.window, self.prefixes = window, prefixes
        self.groups = max(1, -(-total // group_names))
        self.heavy = counts > 2 * total / (1 << SLOT_BITS) + group_names / 8

    def of(self, found: Suffixes, names: np.ndarray, picked: np.ndarray) -> np.ndarray:
        chosen = names.copy()
        open_ = np.arange(len(picked))
        for level, depth in enumerate(self.prefixes):
            prefix = found.names(depth, picked[open_])
            heavy = self.heavy[level][_slot(prefix)]
            chosen[open_[~heavy]] = prefix[~heavy]
            open_ = open_[heavy]
        return (_mixed(chosen) % np.uint64(self.groups)).astype(np.int64)


class Batch:
    """The distinct texts of one batch and the nodes of their suffixes, in the order that sending and answering share."""

    def __init__(self, part: pd.DataFrame, placement: Placement):
        part = part.sort_values(["k1", "k2"], kind="stable")
        copies = part.groupby(["k1", "k2"], sort=True)["n"].sum()
        self.texts = part[part["text"].notna()].drop_duplicates(["k1", "k2"])
        repeated = copies.to_numpy() > 1
        self.words = [words_of(x) for x in self.texts["text"]]
        found = self.found = Suffixes(self.words, placement.window)
        names = found.names(placement.window)
        nodes, first, self.inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        self.shared = counts > 1  # known to repeat within the batch
        self.shared[self.inverse[np.repeat(repeated, found.counts)]] = True
        group = placement.of(found, nodes, first)
        self.order = np.lexsort((nodes, self.shared, group))
        self.group, self.nodes = group[self.order], nodes[self.order]

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, places of nodes seen once, places of nodes known to repeat) in the batch's order."""
        shared = self.shared[self.order]
        edges = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1], True]) if len(self.group) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            middle = lo + int(np.count_nonzero(~shared[lo:hi]))
            yield int(self.group[lo]), np.arange(lo, middle), np.arange(middle, hi)


def _node_messages(placement: Placement):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(part, placement)
        rows = [(group, int(part["batch"].iloc[0]), batch.nodes[once].tobytes(), batch.nodes[more].tobytes())
                for group, once, more in batch.parts()]
        return pd.DataFrame(rows, columns=["grp", "batch", "once", "more"])

    return run


def _deep_nodes(part: pd.DataFrame) -> pd.DataFrame:
    """One group: which nodes, of those a batch passes once, other suffixes pass too."""
    once = [np.frombuffer(x, np.uint64) for x in part["once"]]
    more = np.unique(np.frombuffer(b"".join(part["more"]), np.uint64))
    nodes, inverse, counts = np.unique(np.concatenate(once), return_inverse=True, return_counts=True)
    deep = counts > 1
    if len(more) and len(nodes):
        at = np.minimum(np.searchsorted(more, nodes), len(more) - 1)
        deep |= more[at] == nodes
    answers = np.split(deep[inverse], np.cumsum([len(x) for x in once])[:-1])
    return pd.DataFrame({"batch": part["batch"], "grp": part["grp"], "bits": [np.packbits(x).tobytes() for x in answers]})


def _answers(placement: Placement):
    def run(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(part, placement)
        bits = dict(zip(answers["grp"], answers["bits"]))
        deep = np.ones(len(batch.nodes), bool)
        for group, once, _ in batch.parts():
            deep[once] = np.unpackbits(np.frombuffer(bits[group], np.uint8), count=len(once)).astype(bool)
        by_node = np.empty(len(deep), bool)
        by_node[batch.order] = deep
        repeated = by_node[batch.inverse]
        edge = np.zeros(int(batch.found.offsets[-1]) + 1, np.int64)
        np.add.at(edge, batch.found.starts[repeated], 1)
        np.add.at(edge, batch.found.starts[repeated] + placement.window, -1)
        gone = np.cumsum(edge) > 0
        rows = []
        for (k1, k2), words, lo in zip(batch.texts[["k1", "k2"]].itertuples(index=False), batch.words, batch.found.offsets):
            out = gone[lo: lo + len(words)]
            turns = np.flatnonzero(np.diff(np.r_[0, out.view(np.int8), 0]))
            kept = b" ".join([w for w, x in zip(words, out.tolist()) if not x]) if len(turns) else b" ".join(words)
            rows.append((k1, k2, len(words), int(out.sum()), turns.reshape(-1, 2).tolist(), kept.decode()))
        return pd.DataFrame(rows, columns=["k1", "k2", "n_words", "n_removed", "repeats", "kept_text"])

    return run


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of one partition without repetition; how often a text came again follows as rows without it."""
    again: dict[tuple[int, int], int] = {}
    names = ["k1", "k2", "text", "n"]
    for batch in batches:
        fresh = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key in again:
                again[key] += 1
            else:
                again[key] = 0
                fresh.append(i)
        picked = batch.take(pa.array(fresh, pa.int64()))
        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.ones(len(fresh), np.int64))], names=names)
    more = [(a, b, n) for (a, b), n in again.items() if n]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in more], pa.int64()), pa.array([x[1] for x in more], pa.int64()),
                                      pa.nulls(len(more), pa.string()), pa.array([x[2] for x in more], pa.int64())], names=names)


def repeated_passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES,
                      batch_bytes: int = BATCH_BYTES, group_names: int = GROUP_NAMES) -> DataFrame:
    """A row for each different text: k1, k2 (see ``text_key``), n_words, n_removed, repeats, kept_text.

    ``repeats`` are the maximal runs of words, as [start, end), that windows cover
    whose words also start anywhere else, in the same text included; ``kept_text`` has
    the other words, joined by one space. Null texts count as empty. Copies of a text
    are read once and all their windows repeat. A text of fewer than ``window`` words
    keeps all. An empty table gives no rows.
    """
    text = empty_if_null(F.col(text_col)).cast("string")
    texts = docs.select(*text_key(text), text.alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total, counts = _count_prefixes(texts, window, prefixes)
    placement = Placement(total, counts, window, prefixes, group_names)
    batches = max(1, -(-size // batch_bytes))
    held = texts.mapInArrow(_first_copies, "k1 long, k2 long, text string, n long").withColumn("batch", F.pmod("k1", F.lit(batches)))
    sent = held.groupBy("batch").applyInPandas(_node_messages(placement), "grp long, batch long, once binary, more binary")
    deep = sent.groupBy("grp").applyInPandas(_deep_nodes, "batch long, grp long, bits binary")
    return held.groupBy("batch").cogroup(deep.groupBy("batch")).applyInPandas(
        _answers(placement), "k1 long, k2 long, n_words long, n_removed long, repeats array<array<long>>, kept_text string")
