"""Training-order materialisation: every sequence gets a slot by a keyed permutation and goes to a fixed-stride shard.

The permutation of [0, n) is a Feistel network over the next even number of bits
whose values beyond n are sent through it again (cycle-walking), so each slot is
computed from the sequence's number alone: no shuffle decides the order, and a
reader can compute which sequence stands in any slot. Shards hold ``per_shard``
records of ``stride`` bytes each; record i of the whole order is at byte
(i mod per_shard) * stride of shard i div per_shard.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048  # tokens of a sequence
PER_SHARD = 8192  # records of a shard
ROUNDS = 6
HEAD = 4  # bytes before the tokens of a record: how many of them count


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of [0, n), in both directions."""

    n: int
    key: int

    def _network(self, x: np.ndarray, backwards: bool) -> np.ndarray:
        half = np.uint64(max(1, (max(self.n - 1, 1).bit_length() + 1) // 2))
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        for turn in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
            salt = np.uint64((self.key * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) % (1 << 64))
            if backwards:
                left, right = right ^ (_mixed(left ^ salt) & mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ salt) & mask)
        return (left << half) | right

    def _walked(self, values: np.ndarray, backwards: bool) -> np.ndarray:
        x = self._network(np.asarray(values, np.uint64), backwards)
        while len(outside := np.flatnonzero(x >= np.uint64(self.n))):
            x[outside] = self._network(x[outside], backwards)
        return x.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walked(numbers, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walked(slots, True)


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


def _store(folder: str, name: str, write) -> None:
    """A whole file or none: a lost or repeated task leaves nothing half written under the name."""
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        write(out)
    files.move(draft, f"{path}/{name}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(sequences: DataFrame, folder: str, id_col: str = "id", tokens_col: str = "tokens", width: int = 1, key: int = 1,
                 sequence: int = SEQUENCE, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes the rows' tokens in training order and returns where they went.

    ``tokens_col`` is binary: token ids of ``width`` bytes each, little-endian. The
    rows of a partition follow each other in one stream, which is cut into sequences
    of ``sequence`` tokens; only a partition's last one is padded, with zeros, and a
    record says how many tokens count. The result has a row for each part of a row
    that stands in one sequence: id, part (from 0), number, slot, shard, record,
    start (its first token in the sequence), n_tokens, sha256 (of the shard). Rows
    without tokens (null or empty) have none. ``folder`` has to be seen by all
    executors; a shard is written under its name only when it is whole, and writing it
    again gives the same bytes.

    ``sequences`` has to give the same rows in the same partitions whenever it is
    read, as files do; the second pass fails if it doesn't. As with zipWithIndex the
    driver keeps one count for each partition.
    """
    record = sequence * width
    rows = sequences.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(tokens_col), F.lit(b"")).alias("tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sum(x for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-size // record)], pa.int64())], names=["part", "n"])

    counted = rows.select(F.octet_length("tokens").cast("long").alias("size")).mapInArrow(count, "part int, n long").collect()
    held = {r["part"]: r["n"] for r in counted}
    total, base = 0, {}
    for part in sorted(held):
        base[part] = total
        total += held[part]
    order = Permutation(total, key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_partition = TaskContext.get().partitionId()
        start = at = base.get(at_partition, 0)
        done: list[tuple] = []  # whole sequences: tokens, and the id, part and length of each piece
        pieces: list[tuple] = []
        room = record

        def closed() -> None:
            nonlocal pieces, room
            done.append((b"".join(p[3] for p in pieces), [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces]))
            pieces, room = [], record

        def ready() -> pa.RecordBatch:
            nonlocal at
            numbers = np.arange(at, at + len(done))
            at += len(done)
            columns = [pa.array(numbers), pa.array(order.slots(numbers)), pa.array([d[0] for d in done], pa.binary())]
            columns += [pa.array([d[i] for d in done], pa.list_(pa.int64())) for i in (1, 2, 3)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["number", "slot", "tokens", "ids", "parts", "sizes"])

        for batch in batches:
            for row, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, taken, part = tokens.as_py(), 0, 0
                while taken < len(raw):
                    piece = raw[taken: taken + room]
                    pieces.append((row, part, len(piece) // width, piece))
                    taken, part, room = taken + len(piece), part + 1, room - len(piece)
                    if not room:
                        closed()
            if done:
                yield ready()
        if pieces:
            closed()
        if done:
            yield ready()
        if at - start != held.get(at_partition, 0):
            raise ValueError("the rows of a partition have changed between two reads; write them to files first")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "part", "number", "slot", "shard", "record", "start", "n_tokens", "sha256"]

        def finished(held: list[pa.RecordBatch], shard: int) -> pa.RecordBatch:
            digest = hashlib.sha256()
            out = []

            def write(file):
                for batch in held:
                    for number, slot, raw, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                        line = (len(raw) // width).to_bytes(HEAD, "little") + raw + bytes(record - len(raw))
                        digest.update(line)
                        file.write(line)
                        at = 0
                        for row, part, size in zip(*rest):
                            out.append((row, part, number, slot, shard, slot % per_shard, at, size))
                            at += size

            _store(folder, shard_name(shard), write)
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(8)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([digest.hexdigest()] * len(out), pa.string())], names=names)

        held, current = [], None
        for batch in batches:  # the rows come by slot, and so shard by shard
            shards = batch.column(1).to_numpy() // per_shard
            edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]) if len(shards) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and shards[lo] != current:
                    yield finished(held, int(current))
                    held = []
                current = shards[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield finished(held, int(current))

    placed = rows.mapInArrow(place, "number long, slot long, tokens binary, ids array<long>, parts array<long>, sizes array<long>")
    shards = max(1, -(-total // per_shard))
    # Partition i is the range of slots of shard i; no sampling is needed to find the bounds.
    dealt = placed.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    return dealt.mapInArrow(store, "id long, part long, number long, slot long, shard long, record long, start long, n_tokens long, sha256 string")


def read_records(folder: str, first: int, count: int, width: int = 1, sequence: int = SEQUENCE, per_shard: int = PER_SHARD) -> Iterator[bytes]:
    """The tokens of ``count`` slots from ``first`` on: a seek into one shard, then reading on."""
    files, path = _filesystem(folder)
    stride = HEAD + sequence * width
    slot, end = first, first + count
    while slot < end:
        with files.open_input_file(os.path.join(path, shard_name(slot // per_shard))) as held:
            held.seek(slot % per_shard * stride)
            for _ in range(min(end - slot, per_shard - slot % per_shard)):
                line = held.read(stride)
                size = int.from_bytes(line[:HEAD], "little")
                yield line[HEAD: HEAD + size * width]
                slot += 1
