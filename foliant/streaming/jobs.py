"""Structured Streaming jobs on the same rules as the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.functions.formats import known_extension
from foliant.operators import reading
from foliant.sources import manifests
from foliant.sources.files import content_hash, dedupe_import, intake_candidate, list_files

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


# --- incoming folder -------------------------------------------------------------------


def watch_folder(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of candidates in an incoming folder; the file log hands each file out once."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).load(path)
    )
    known = known_extension(F.col("path")) != ""
    return files.where(intake_candidate(F.col("path"))).select(
        F.col("path").alias("id"), F.col("length").alias("size"), content_hash(F.col("content")).alias("hash"), known.alias("supported"))


def intake(candidates: DataFrame, assets: DataFrame, books: DataFrame, output: str, checkpoint: str):
    """Write every candidate's outcome: imported, duplicate, duplicate_trashed or failed.

    Equal bytes arriving together are imported once. A batch overwrites its
    own folder, so a repeated batch leaves the same files.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        done = dedupe_import(batch.where("supported").select("id", "size", "hash"), assets, books).select("id", "status")
        failed = batch.where("NOT supported").select("id", F.lit("failed").alias("status"))
        done.unionByName(failed).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return candidates.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- files that are still being written ---------------------------------------------------

SIGHTINGS = "scan bigint, path string, fingerprint string"
RELEASES = "path string, fingerprint string, released_at bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def record_scan(spark: SparkSession, folder: str, scan: int, sightings: str) -> None:
    """Append one scan of an incoming folder to a table of sightings, the input of :func:`stable_files`.

    A scan written twice replaces itself. Contents are not read: size and time of change tell states apart.
    """
    seen = list_files(spark, folder).where(intake_candidate(F.col("path")))
    seen.select(F.lit(scan).cast("long").alias("scan"), "path", F.concat_ws(":", "size", "mtime").alias("fingerprint")).write.mode(
        "overwrite").parquet(f"{sightings}/batch={scan:010d}")


class _Gate(StatefulProcessor):
    """Per path: the scan that saw it last, its fingerprint and how often in a row; a timer forgets it."""

    def __init__(self, n: int, forget_scans: int):
        self.n, self.forget_ms = n, forget_scans * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "scan bigint, fingerprint string, times bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, fingerprint, times = self.seen.get() if self.seen.exists() else (None, None, 0)
        out = []
        # Rows of one micro-batch come in any order; a path has one in each scan.
        for row in pd.concat(list(rows)).sort_values("scan").itertuples(index=False):
            if at is not None and row.scan <= at:
                continue  # seen before
            times = times + 1 if at is not None and row.scan == at + 1 and fingerprint is not None and row.fingerprint == fingerprint else 1
            at, fingerprint = int(row.scan), row.fingerprint
            if times == self.n:
                out.append((key[0], fingerprint, at))
        self.seen.update((at, fingerprint, times))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((at + 1) * 1000 + self.forget_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RELEASES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in RELEASES.split(", ")])

    def close(self) -> None:
        pass


def stable_files(sightings: DataFrame, n: int, late_scans: int = 1) -> DataFrame:
    """Stream of files at the scan that saw them unchanged ``n`` times in a row: ``stability_gate`` on a stream.

    ``sightings`` is a stream of (scan, path, fingerprint), scans counted from 0. Scans
    may arrive in several batches, in order, up to ``late_scans`` late. The state of a
    path is three values (RocksDB); a path that no scan has named for so long that it
    can't go on a run leaves the state, so the state is as large as the folder.
    """
    # A watermark starts at the epoch and drops what is not after it, so scan 0 has the first second.
    timed = sightings.where("scan IS NOT NULL AND path IS NOT NULL").withColumn("scanned_at", F.timestamp_seconds(F.col("scan") + 1)).withWatermark(
        "scanned_at", f"{late_scans} seconds")
    return timed.groupBy("path").transformWithStateInPandas(
        _Gate(n, late_scans + 1), RELEASES, outputMode="Append", timeMode="EventTime")


def release(sightings: DataFrame, n: int, output: str, checkpoint: str):
    """Write the released files of all sightings that have arrived; started again it goes on after those.

    Timers and state variables need the RocksDB state store, which is set for the session.
    """
    sightings.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return stable_files(sightings, n).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(output)


# --- sessions --------------------------------------------------------------------------

SPANS = "user_id bigint, source_id string, received_at bigint, seq bigint, span_from bigint, span_to bigint, counted_ms bigint"


def session_spans(events: DataFrame, idle_ms: int = reading.IDLE_MS, forget_after_ms: int | None = None) -> DataFrame:
    """Newly counted spans of reading time, with the sessions of a user as keyed state.

    A new session closes the user's open ones. A session that has ended and got no
    event in a micro-batch leaves the state only with its user: a caller who names
    ``forget_after_ms`` lets the watermark drop reports that much late and forgets
    users without events for as long. Without it nothing is dropped, as in the
    batch operator.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sessions = {k: reading.Session(**v) for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        # Rows of one micro-batch come in any order; a batch is bounded by its trigger.
        rows = pd.concat(list(batches)).sort_values(["received_at", "seq"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if row.kind == "start" and row.source_id not in sessions:
                leave = row._replace(kind="takeover")
                for other in list(sessions):
                    sessions[other], _, _ = reading.session_event(sessions[other], leave, idle_ms)
            session, start, end = reading.session_event(sessions.get(row.source_id), row, idle_ms)
            if session is not None:
                sessions[row.source_id] = session
                if end > start:
                    out.append((key[0], row.source_id, row.received_at, row.seq, start, end, session.counted))
        state.update((json.dumps({k: asdict(s) for k, s in sessions.items()}),))
        if forget_after_ms:
            state.setTimeoutTimestamp(max(int(rows["received_at"].max()), state.getCurrentWatermarkMs()) + forget_after_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SPANS.split(", ")])

    if forget_after_ms:
        events = events.withColumn("event_time", F.timestamp_millis("received_at")).withWatermark("event_time", f"{forget_after_ms} milliseconds")
    timeout = GroupStateTimeout.EventTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("user_id").applyInPandasWithState(advance, SPANS, "sessions string", "append", timeout)


# --- latest values as versioned snapshots ---------------------------------------------------


def keep_snapshot(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame],
                  keys: list[str], buckets: int = 64, keep: int = 2):
    """Fold a stream into a table without MERGE: each batch rewrites the buckets of its keys and no others.

    Rows lie in ``buckets`` by the hash of their keys. A version is a small file that
    names the batch which wrote each bucket last. A batch starts from the newest version
    before its own and overwrites its own files, so that a repeated batch gives the same
    result. Files that none of the newest ``keep`` versions names are removed; with two
    or more a batch can be repeated. Choose the buckets so that one is a task's work.
    The number of buckets is fixed with the first batch.
    """
    if keep < 2:
        raise ValueError("a batch is repeated from the version before it: keep two or more")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = _buckets(spark, path, latest_version(spark, path, epoch))
        # As long as the number of buckets.
        touched = {r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()}
        held = {b: e for b, e in earlier.items() if b in touched}
        merged = merge(_read_buckets(spark, path, held) if held else None, batch)
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/files/epoch={epoch}")
        manifests.put(spark, f"{path}/versions", f"{epoch:012d}", json.dumps({**earlier, **dict.fromkeys(touched, epoch)}), replace=True)
        _prune(spark, path, keep)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Newest complete version, below ``before`` if that is given."""
    known = [int(name) for name in manifests.names(spark, f"{path}/versions")]
    return max((v for v in known if before is None or v < before), default=None)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, by default the newest one."""
    newest = latest_version(spark, path) if version is None else version
    held = _buckets(spark, path, newest)
    if not held:
        raise LookupError(f"no rows have been written to {path}")
    return _read_buckets(spark, path, held)


def _buckets(spark: SparkSession, path: str, version: int | None) -> dict[int, int]:
    """Which batch wrote each bucket last."""
    if version is None:
        return {}
    return {int(b): e for b, e in json.loads(manifests.get(spark, f"{path}/versions", f"{version:012d}")).items()}


def _read_buckets(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/files/epoch={e}/bucket={b}" for b, e in sorted(held.items())])


def _prune(spark: SparkSession, path: str, keep: int) -> None:
    """Remove old versions, and the buckets that the kept ones have replaced; a batch's folder goes with its last bucket."""
    known = [int(name) for name in manifests.names(spark, f"{path}/versions")]
    kept = {(e, b) for v in known[-keep:] for b, e in _buckets(spark, path, v).items()}
    for version in known[:-keep]:
        manifests.drop(spark, f"{path}/versions/{version:012d}")
    for folder in manifests.names(spark, f"{path}/files"):
        epoch = int(folder.split("=")[1])
        if epoch >= known[-1]:
            continue
        there = [int(name.split("=")[1]) for name in manifests.names(spark, f"{path}/files/{folder}")]
        gone = [b for b in there if (epoch, b) not in kept]
        for b in gone if len(gone) < len(there) else []:
            manifests.drop(spark, f"{path}/files/{folder}/bucket={b}")
        if len(gone) == len(there):
            manifests.drop(spark, f"{path}/files/{folder}")


POSITION = ["user_id", "asset_id", "progress", "device_id", "modified_at", "seq", "revision"]


def merge_positions(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Newest position per user and asset; late writes lose whenever they arrive.

    Only the maximum of (modified_at, seq) and a count are kept, so batches
    may come in any order and hot keys are reduced before the shuffle.
    """
    rows = batch.withColumn("revision", F.lit(1).cast("long")).select(*POSITION)
    both = rows if current is None else rows.unionByName(current.select(*POSITION))
    newest = F.max_by(F.struct("progress", "device_id", "modified_at", "seq"), F.struct("modified_at", "seq"))
    return both.groupBy("user_id", "asset_id").agg(newest.alias("p"), F.sum("revision").alias("revision")).select(
        "user_id", "asset_id", "p.progress", "p.device_id", "p.modified_at", "p.seq", "revision")


def position_snapshot(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    return keep_snapshot(stream, path, checkpoint, merge_positions, ["user_id", "asset_id"], buckets)


def merge_status(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Current status per user and book from status events."""
    rows = batch.select("user_id", "book_id", "status", "at_s", "id")
    both = rows if current is None else rows.unionByName(current)
    last = F.max_by(F.struct("status", "at_s", "id"), F.struct("at_s", "id"))
    return both.groupBy("user_id", "book_id").agg(last.alias("s")).select("user_id", "book_id", "s.status", "s.at_s", "s.id")


def status_snapshot(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    return keep_snapshot(stream, path, checkpoint, merge_status, ["user_id", "book_id"], buckets)
