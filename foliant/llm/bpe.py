"""Byte-level BPE: pre-tokens found by a scan of transition functions over code point classes, then cached pair merging.

A text is an array of code points, each of one class. The pattern of byte-level BPE
becomes a small automaton over classes; a class that looks ahead (white space before
other text, an apostrophe before a contraction) is told apart by array comparisons
beforehand. Each class is a function from state to state. All products of these
functions form a small finite monoid, so a prefix scan needs one table lookup for
each code point: blocks are scanned side by side, block products are combined by
doubling, and the entry states finish it.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of code points.
END, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, GAP, BLANK, NONE = range(10)
# States: what the open token is.
FRESH, WORD, DIGITS, MARKS, JOINED, RUN, ONE_MORE, TWO_MORE = range(8)
# The white space of Unicode.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Contractions that are tokens of their own.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")

BLOCK = 256
CHUNK = 1 << 19  # code points scanned at once; a longer text is scanned whole
CACHED = 200_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by state and class."""
    step = np.zeros((8, 10), np.uint8)
    cut = np.ones((8, 10), bool)
    for symbol, state in ((LETTER, WORD), (NUMBER, DIGITS), (OTHER, MARKS), (BLANK, RUN)):
        step[:, symbol] = state
        cut[state, symbol] = False
    for symbol, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # within marks an apostrophe is one more of them
        step[:, symbol] = state
        step[[MARKS, JOINED], symbol] = MARKS
        cut[[MARKS, JOINED], symbol] = False
    cut[JOINED, [LETTER, NUMBER, OTHER]] = False
    step[:, SPACE], step[:, GAP], step[:, END] = JOINED, FRESH, FRESH
    step[TWO_MORE, LETTER], step[ONE_MORE, LETTER] = ONE_MORE, FRESH
    cut[[ONE_MORE, TWO_MORE], LETTER] = False
    step[:, NONE] = np.arange(8)
    return step, cut


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, products of elements, element applied to a state)."""
    step, _ = _automaton()
    generators = [tuple(step[:, symbol]) for symbol in range(10)]
    elements = list(dict.fromkeys(generators))
    for held in elements:  # grows while it is walked
        for g in generators:
            if (made := tuple(g[s] for s in held)) not in elements:
                elements.append(made)
    place = {e: i for i, e in enumerate(elements)}
    product = np.array([[place[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint8)
    return np.array([place[g] for g in generators], np.uint8), product, np.array(elements, np.uint8)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = BLANK
    return table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of code points; ``ends`` are the places of the separators that close each text."""
    found = _classes()[points]
    found[ends] = END
    after = np.append(found[1:], END)
    blank_next = (after == BLANK) | (after == END)
    white = found == BLANK
    found[white & ~blank_next & (points == 32)] = SPACE
    found[white & ~blank_next & (points != 32)] = GAP
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        found[quotes[np.isin(one, [ord(c) for c in SHORT_TAILS])]] = SHORT
        for tail in LONG_TAILS:
            found[quotes[(one == ord(tail[0])) & (two == ord(tail[1]))]] = LONG
    return found


def token_starts(found: np.ndarray) -> np.ndarray:
    """Whether a pre-token, or a separator, starts at each place."""
    element, product, apply = _monoid()
    step, cut = _automaton()
    n = len(found)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, NONE, np.uint8)
    padded[:n] = found
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    size = len(product)
    flat = product.ravel()
    scan = np.empty((BLOCK, blocks), np.uint8)
    scan[0] = element[columns[0]]
    for t in range(1, BLOCK):
        scan[t] = flat[scan[t - 1].astype(np.int32) * size + element[columns[t]]]
    whole = scan[-1].copy()
    reach = 1
    while reach < blocks:  # products of ever more blocks to the left
        whole[reach:] = flat[whole[:-reach].astype(np.int32) * size + whole[reach:]]
        reach *= 2
    entry = np.full(blocks, FRESH, np.uint8)
    entry[1:] = apply[whole[:-1], FRESH]
    before = np.empty((BLOCK, blocks), np.uint8)
    before[0] = entry
    before[1:] = apply.ravel()[scan[:-1].astype(np.int32) * 8 + entry[None, :]]
    return cut.ravel()[before.astype(np.int32) * 10 + columns].T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pre-tokens of all texts as bytes, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    starts = np.flatnonzero(token_starts(symbols(points, ends)))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.append(np.cumsum(width, dtype=np.int64), 0)[starts - 1]
    buffer = joined.encode()
    closes = np.isin(starts, ends, assume_unique=True)
    opens = np.flatnonzero(~closes)
    counts = np.diff(np.searchsorted(opens, np.append(0, np.flatnonzero(closes))))
    return list(map(buffer.__getitem__, map(slice, at[opens].tolist(), at[opens + 1].tolist()))), counts


class Codec:
    """Ranks of a byte-level vocabulary; ``raw`` has a base64 token and its rank on each line."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # Ids of single bytes, and ranks of what two bytes make.
        self.bytes = [self.ranks.get(bytes([b])) for b in range(256)]
        self.twos = [[self.ranks.get(bytes([a, b]), len(self.tokens)) for b in range(256)] for a in range(256)]
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        if (rank := self.ranks.get(piece)) is not None:
            return (rank,)
        return self._merged_long(piece) if len(piece) > 128 else self._merged_short(piece)

    def _merged_short(self, piece: bytes) -> tuple[int, ...]:
        get, none, twos, single = self.ranks.get, len(self.tokens), self.twos, self.bytes
        edges = list(range(len(piece) + 1))
        ids = [single[b] for b in piece]
        pairs = [twos[a][b] for a, b in zip(piece, piece[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            ids[i] = low
            del edges[i + 1], pairs[i], ids[i + 1]
            if i:
                pairs[i - 1] = get(piece[edges[i - 1]: edges[i + 1]], none)
            if i < len(pairs):
                pairs[i] = get(piece[edges[i]: edges[i + 2]], none)
        if None in ids:
            raise KeyError(f"a byte of {piece!r} has no rank")
        return tuple(ids)

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours of the part that starts at a place
        waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i: i + 2])) is not None]
        heapq.heapify(waiting)
        alive = bytearray(b"\1") * n
        while waiting:
            _, left, end = heapq.heappop(waiting)
            right = after[left]
            if not alive[left] or right >= n or after[right] != end:
                continue  # one of the two has merged since
            alive[right] = 0
            after[left] = end
            if end < n:
                before[end] = left
                if (rank := get(piece[left: after[end]])) is not None:
                    heapq.heappush(waiting, (rank, left, after[end]))
            if (start := before[left]) >= 0 and (rank := get(piece[start:end])) is not None:
                heapq.heappush(waiting, (rank, start, end))
        return tuple(self.ranks[piece[i: after[i]]] for i in range(n) if alive[i])

    def _seldom(self, piece: bytes) -> tuple[int, ...]:
        found = self.old.get(piece) or self.merged(piece)
        if len(self.young) >= CACHED:  # what was not asked for since the last turn is forgotten
            self.old, self.young = self.young, {}
        if len(piece) <= 64:
            self.young[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut, counts = pieces(texts)
        seldom, out, at = self._seldom, [], 0
        for count in counts.tolist():
            get = self.young.get
            out.append(list(chain.from_iterable([get(p) or seldom(p) for p in cut[at: at + count]])))
            at += count
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def _codec(raw: bytes) -> Codec:
    return Codec(raw)


def _vocabulary(df: DataFrame, path: str):
    """The rank file, read once on the driver; its size is that of one vocabulary, whatever the corpus."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(id, ids[, starts]) of every row: token ids of the whole text and, for each, its first byte in the text.

    ``path`` names a file of base64 tokens and ranks. No string is special. A null
    text counts as empty and has no ids; equal rows stay separate; an empty table
    gives none.
    """
    held = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        lengths = np.fromiter(map(len, codec.tokens), np.int32, len(codec.tokens))

        def made(keys, texts):
            found = codec.encode(texts)
            arrays = [pa.array(keys, pa.int64())]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            edges = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            arrays.append(pa.ListArray.from_arrays(edges, pa.array(flat)))
            if offsets:
                ends = np.cumsum(lengths[flat])
                first = np.append(0, ends)[np.append(0, np.cumsum(sizes))[:-1]]
                arrays.append(pa.ListArray.from_arrays(edges, pa.array((ends - lengths[flat] - np.repeat(first, sizes)).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names=["id", "ids", "starts"][: len(arrays)])

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1]) + 1
                if size >= CHUNK:
                    yield made(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield made(keys, texts)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, ids array<int>" + ", starts array<int>" * offsets)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``bytes``, the bytes that the ids stand for; null ids decode as none.

    An id outside the vocabulary is an error. A column ``bytes`` of ``df`` is replaced.
    """
    held = _vocabulary(df, path)
    kept = [c for c in df.columns if c != "bytes"]
    frame = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            ids = batch.column(kept.index(ids_col))
            values = [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*kept, "bytes"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("bytes", T.BinaryType())]))
