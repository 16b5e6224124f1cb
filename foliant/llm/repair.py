"""Conversation repair by bidirectional Dijkstra over the lattice of edits.

A lattice point is (rows read, state), the state being the role written last: none, s,
u or a. Each edit of a row leads to one point: keeping it, giving it the role that is
due, deleting it, or inserting an empty turn of the role that is due before it. From
both ends a heap grows the cheapest distances until no cheaper or equal crossing can
come; the audit is the ASCII-least walk over points and crossings of the least cost.

Rows are range-partitioned by conversation and turn, so a long conversation spans many
partitions. One that lies within a partition is solved at once. Of the first and last
one of a partition, which may go on elsewhere, the partition solves its piece from
each state to each state; the pieces are then put together in order.
"""

from __future__ import annotations

import hashlib
import heapq
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.shared import discard, new_path, written

# ASCII white space, costs of the edits, roles by initial, and what damage does by remainder.
BLANK = r"^[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
DAMAGE = 20
DROPPED, EMPTIED, UNENDED, REPEATED, REROLED = range(5)

STATES = "-sua"  # nothing written yet, and the role written last
DUE = {"-": "u", "s": "u", "u": "a", "a": "u"}
ENDS = ("-", "a")
SOUND, TRUNCATED, REMOVED = 0, 1, 2  # of a row: may stay, may stay at a price, has to go
PAIRS = ("su", "ua", "au")
NOWHERE = 1 << 62


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) harmed by what crc32 of ``conv_id:turn`` says; nulls count as one space there."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.col("harm")
    rows = rows.withColumn("harm", F.crc32(F.concat_ws(":", *known).cast("binary")) % DAMAGE).where(harm != DROPPED)
    return rows.select(
        "conv_id", "turn", F.when(harm == REROLED, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == EMPTIED, "").when(harm == UNENDED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(harm == REPEATED, 2).otherwise(1))).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) numbered by ``copy`` among equal ones, with the first ``fault`` of each: blank, duplicate, truncated or null.

    A row is a duplicate if its role and text stand earlier in the conversation: all
    but the first copy of the first turn. Copies are counted and first turns are a
    minimum, both reduced before their shuffles, so that a row or text which a
    conversation repeats without end is not one task's work.
    """
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumns(
        {"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(7), "role", "text"), "place": F.struct(F.col("turn").isNotNull(), "turn")})
    firsts = alike.groupBy("conv_id", "k1", "k2").agg(F.min("place").alias("first"), F.count("*").alias("turns")).where("turns > 1").select(
        F.col("conv_id").alias("c"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    held = alike.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    again = (F.col("copy") > 1) | (F.col("first").isNotNull() & ~F.col("place").eqNullSafe(F.col("first")))
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(again, "duplicate").when(F.col("text").rlike(CUT_OFF), "truncated")
    return held.select("conv_id", "turn", "role", "text", "place", "first", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(
        "conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


def edits(state: str, initial: str, fault: int) -> Iterator[tuple[str, str, int]]:
    """(letter, next state, cost) of each edit that reads a row; inserting reads none."""
    price = UNFINISHED if fault == TRUNCATED else 0
    yield "D", state, DELETE
    if fault != REMOVED:
        if initial == DUE[state] or initial == "s" and state == "-":
            yield "K", initial, KEEP + price
        yield "R", DUE[state], REROLE + price


class Lattice:
    """Points are row * 4 + state; ``initials`` and ``faults`` have one entry for each row."""

    def __init__(self, initials: str, faults: list[int]):
        self.initials, self.faults, self.rows = initials, faults, len(faults)
        self.steps: dict[tuple[str, str, int], list] = {}

    def ahead(self, point: int) -> list[tuple[str, int, int]]:
        """(letter, point, cost), by letter."""
        row, state = divmod(point, 4)
        out = [("I", point - state + STATES.index(DUE[STATES[state]]), INSERT)]
        if row < self.rows:
            key = (STATES[state], self.initials[row], self.faults[row])
            if key not in self.steps:
                self.steps[key] = [(letter, 4 + STATES.index(to), cost) for letter, to, cost in edits(*key)]
            out += [(letter, point - state + to, cost) for letter, to, cost in self.steps[key]]
        return sorted(out)

    def behind(self, point: int) -> list[tuple[int, int]]:
        """(point, cost) of the edits that lead here."""
        row, state = divmod(point, 4)
        out = [(point - state + i, INSERT) for i in range(4) if STATES[state] == DUE[STATES[i]]]
        if row:
            base = point - state - 4
            out += [(base + i, cost) for i in range(4) for _, to, cost in edits(STATES[i], self.initials[row - 1], self.faults[row - 1]) if to == STATES[state]]
        return out

    def cheapest(self, start: str, stops: tuple[str, ...]) -> tuple[int, str] | None:
        """(cost, audit) from state ``start`` before the first row to one of ``stops`` after the last; None if there is no way."""
        first = STATES.index(start)
        far: dict[int, int] = {first: 0}
        ends = {self.rows * 4 + STATES.index(stop): 0 for stop in stops}
        near: dict[int, int] = dict(ends)
        heaps = [[(0, point) for point in side] for side in (far, near)]
        done: tuple[dict[int, int], dict[int, int]] = ({}, {})
        best = min((far[p] + near[p] for p in far if p in near), default=NOWHERE)
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:  # equal crossings are finished too
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            cost, point = heapq.heappop(heaps[side])
            if point in done[side]:
                continue
            done[side][point] = cost
            own, other = (far, near) if side == 0 else (near, far)
            for to, more in ((to, more) for _, to, more in self.ahead(point)) if side == 0 else self.behind(point):
                if cost + more < own.get(to, NOWHERE):
                    own[to] = cost + more
                    heapq.heappush(heaps[side], (cost + more, to))
                if to in other:
                    best = min(best, own[to] + other[to])
        if best == NOWHERE:
            return None
        return best, self._least(first, best, done[0], {**done[1], **ends}, ends)

    def _least(self, first: int, best: int, far: dict[int, int], near: dict[int, int], ends: dict[int, int]) -> str:
        """The ASCII-least audit of cost ``best``. A letter leads to one point only, so the walk takes the least letter that stays on a cheapest way.

        From the front the way goes over settled points that reach a crossing, and after it over points that the rear has settled.
        """
        crossing = lambda point, cost: point in near and cost + near[point] == best
        sure = set()
        # Costless edits read a row, so points of equal cost are taken from the last row back.
        for point in sorted(far, key=lambda p: (-far[p], -p // 4)):
            cost = far[point]
            if crossing(point, cost) or any(crossing(to, cost + more) or to in sure and far.get(to) == cost + more for _, to, more in self.ahead(point)):
                sure.add(point)
        out, point, cost = [], first, 0
        while not (point in ends and cost == best):
            letter, point, cost = next((letter, to, cost + more) for letter, to, more in self.ahead(point)
                                       if to in sure and far[to] == cost + more or crossing(to, cost + more))
            out.append(letter)
        return "".join(out)


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in PAIRS for a, b in zip(initials, initials[1:]))


class Written:
    """Digest of the repaired conversation, row by row along an audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.empty = audit, 0, "-", hashlib.sha256(), True

    def _add(self, role: str, text: str, state: str) -> None:
        self.digest.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty, self.state = False, state

    def _inserts(self) -> None:
        while self.audit[self.at: self.at + 1] == "I":
            due = DUE[self.state]
            self._add(ROLES[due], "", due)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._add(role, text, role[:1])
        elif letter == "R":
            self._add(ROLES[DUE[self.state]], text, DUE[self.state])

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


PIECE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("head", T.StringType()),
                      T.StructField("tail", T.StringType()), T.StructField("illegal", T.LongType()),
                      T.StructField("ways", T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("stop", T.StringType()),
                                                                      T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))),
                      T.StructField("sha256", T.StringType())])


def _initial(role: str) -> str:
    return role[:1] or " "


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted partition: solved if it lies within, else as a piece of which all ways are known."""
    part, first, conv, opened = TaskContext.get().partitionId(), True, None, False
    initials: list[str] = []
    faults: list[int] = []
    kept: list[tuple[str, str]] = []  # roles and texts

    def closed(last: bool) -> dict:
        lattice = Lattice("".join(initials), faults)
        out = {"conv_id": conv, "part": part, "head": initials[0], "tail": initials[-1], "illegal": illegal_pairs(lattice.initials)}
        if not first and not last:
            cost, audit = lattice.cheapest("-", ENDS)
            repaired = Written(audit)
            for role, text in kept:
                repaired.row(role, text)
            return {**out, "ways": [{"start": "-", "stop": "", "cost": cost, "audit": audit}], "sha256": repaired.end()}
        ways = [(a, b, lattice.cheapest(a, (b,))) for a in STATES for b in STATES]
        return {**out, "ways": [{"start": a, "stop": b, "cost": w[0], "audit": w[1]} for a, b, w in ways if w], "sha256": None}

    shape = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()),
                       ("ways", pa.list_(pa.struct([("start", pa.string()), ("stop", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
                       ("sha256", pa.string())])
    for batch in batches:
        out = []
        for key, role, text, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault")]):
            if opened and key != conv:
                out.append(closed(False))
                first, initials, faults, kept = False, [], [], []
            conv, opened = key, True
            initials.append(_initial(role))
            faults.append(REMOVED if fault in ("blank", "duplicate") else TRUNCATED if fault else SOUND)
            if not first:  # the texts of pieces are read again once their audit is known
                kept.append((role, text))
        yield pa.RecordBatch.from_pylist(out, shape)
    if opened:
        yield pa.RecordBatch.from_pylist([closed(True)], shape)


def _together(pieces: pd.DataFrame) -> pd.DataFrame:
    """One conversation from its pieces in order: the cheapest way over each state between, the ASCII-least of equals."""
    pieces = pieces.sort_values("part")
    held: dict[str, tuple[int, str]] = {"-": (0, "")}
    illegal, tail = 0, None
    for piece in pieces.itertuples():
        after: dict[str, tuple[int, str]] = {}
        for way in piece.ways:
            if way["start"] in held:
                cost, audit = held[way["start"]]
                found = (cost + way["cost"], audit + way["audit"])
                after[way["stop"]] = min(after.get(way["stop"], found), found)
        held = after
        illegal += piece.illegal + (tail is not None and tail + piece.head not in PAIRS)
        tail = piece.tail
    cost, audit = min(held[end] for end in ENDS if end in held)
    return pd.DataFrame({"conv_id": pieces["conv_id"].iloc[:1].astype("Int64"), "illegal": [illegal], "cost": [cost], "audit": [audit]})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha256) from rows that come by conversation, each one's audit first."""
    conv, repaired = None, None
    for batch in batches:
        out = []
        for key, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]):
            if audit is not None:
                if repaired is not None:
                    out.append((conv, repaired.end()))
                conv, repaired = key, Written(audit)
            else:
                repaired.row(role, text)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "sha256"])
    if repaired is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([repaired.end()], pa.string())], names=["conv_id", "sha256"])


def repaired_conversations(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired_sha256) of each conversation among ``rows`` (conv_id, turn, role, text, copy, fault).

    Costs and letters are those of the module's fixed values; the roles left are
    ``(s?(ua)+)?``. Rows go by turn, nulls first, then by role and text. A null
    conversation id is one conversation. A role's initial is its first character; a
    role without one, or with another, cannot be kept. ``parts`` is the number of
    ranges (default: shuffle partitions). The audit has a letter a row or insert, and
    is the size of its output row; the digest of a conversation that spans partitions
    is streamed by one task, since it is a digest of the whole.
    """
    spark, paths = rows.sparkSession, [new_path(rows.sparkSession) for _ in range(2)]
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "copy")]
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_solved, PIECE), paths[0])
    whole = found.where("sha256 is not null").select("conv_id", "illegal", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"), "sha256")
    cut = written(found.where("sha256 is null").groupBy("conv_id").applyInPandas(_together, "conv_id long, illegal long, cost long, audit string"), paths[1])
    ends = rows.join(cut.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    missing = {"turn": "long", "role": "string", "text": "string", "copy": "int"}
    told = cut.select("conv_id", F.lit(0).alias("kind"), "audit", *[F.lit(None).cast(kind).alias(c) for c, kind in missing.items()])
    told = told.union(ends.select("conv_id", F.lit(1), F.lit(None).cast("string"), *missing))
    digests = told.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order[1:]).mapInArrow(_digested, "conv_id long, sha256 string")
    digests = digests.select(F.col("conv_id").alias("c"), "sha256")
    out = whole.union(cut.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "illegal", "cost", "audit", "sha256"))
    out = written(out.withColumnRenamed("sha256", "repaired_sha256"))
    discard(spark, *paths)
    return out


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         harm: bool = True, parts: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    With ``harm`` the rows are damaged first, as the query wants. Null roles and texts
    count as one space. Rows of equal turns go by role and text; repeated rows are rows
    of their own, and so duplicates. A conversation without rows after damage has
    zeros, an empty audit and the digest of nothing. An empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    path = new_path(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))])
    every = rows.select("conv_id").distinct()
    rows = written(with_faults(damaged(rows) if harm else rows), path)
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count(F.when(F.col("fault") == kind, 1)).cast("long").alias(kind) for kind in ("blank", "duplicate", "truncated")])
    repaired = repaired_conversations(rows, parts)
    counts = counts.select(F.col("conv_id").alias("c1"), "gaps", "blank", "duplicate", "truncated")
    repaired = repaired.withColumnRenamed("conv_id", "c2")
    out = every.join(counts, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(repaired, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zeros], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
