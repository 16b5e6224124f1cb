"""Streams against their batch equivalents, on shuffled and repeated input."""

import os
import time

from pyspark.sql import functions as F

from foliant.operators import reading
from foliant.plans import load_all
from foliant.plans.bindings import bind
from foliant.sources import files
from foliant.streaming import jobs

load_all()
SF = "/root/testdata/sf0.001"


def files_of(df, path, parts, order):
    df.repartitionByRange(parts, order).write.parquet(path)
    return df.schema


def test_sessions_match_batch(spark, tmp_path):
    events = bind(spark, SF).session_events
    cuts = events.approxQuantile("received_at", [0.35, 0.7], 0.0)
    for low, high in zip([0, *cuts], [*cuts, 9e15]):
        part = events.where((F.col("received_at") >= low) & (F.col("received_at") < high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.session_spans(stream, 12 * 3600 * 1000).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    cols = ["user_id", "source_id", "span_from", "span_to"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())
    batch = reading.reading_sessions(events, 12 * 3600 * 1000).where("span_to > span_from")
    assert got == sorted(tuple(r) for r in batch.select(*cols).collect()) and got


def test_positions_in_any_order(spark, tmp_path):
    writes = bind(spark, SF).sync_writes.select("user_id", "asset_id", "progress", "device_id", "modified_at", "seq")
    schema = files_of(writes, str(tmp_path / "in"), 4, "progress")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert jobs.position_snapshot(stream, str(tmp_path / "snap"), str(tmp_path / "ck")).awaitTermination(120)
    last = jobs.latest_version(spark, str(tmp_path / "snap"))
    got = jobs.read_snapshot(spark, str(tmp_path / "snap"))
    want = jobs.merge_positions(None, writes)
    assert last >= 3 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_status_snapshot(spark, tmp_path):
    activity = bind(spark, SF).activity.select("user_id", "book_id", "status", "at_s", "id")
    schema = files_of(activity, str(tmp_path / "in"), 2, "id")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert jobs.status_snapshot(stream, str(tmp_path / "snap"), str(tmp_path / "ck")).awaitTermination(120)
    got = jobs.read_snapshot(spark, str(tmp_path / "snap"))
    assert got.exceptAll(jobs.merge_status(None, activity)).count() == 0 and got.count() > 50


def test_intake_of_a_folder(spark, tmp_path):
    box = tmp_path / "box"
    (box / "deep").mkdir(parents=True)
    for name, data in {"a.epub": b"one", "deep/b.epub": b"one", "c.pdf": b"known", "d.xyz": b"?", ".hid.epub": b"h", "e.epub.part": b"p", "f.epub": b"gone"}.items():
        (box / name).write_bytes(data)
    listing = files.list_files(spark, str(box), content=True).select("path", files.content_hash(F.col("content")).alias("h"), "size")
    hashes = {os.path.basename(r.path): (r.h, r.size) for r in listing.collect()}
    assets = spark.createDataFrame(
        [(1, 10, *[hashes["c.pdf"][0]] * 2, 5, 5), (2, 11, hashes["f.epub"][0], "x" * 32, 4, None)],
        "id long, book_id long, original_hash string, current_hash string, original_size long, current_size long")
    books = spark.createDataFrame([(10, None), (11, 99)], "id long, deleted_at long")
    query = jobs.intake(jobs.watch_folder(spark, str(box)), assets, books, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    got = {os.path.basename(r.id): r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.epub": "imported", "b.epub": "duplicate", "c.pdf": "duplicate", "d.xyz": "failed", "f.epub": "duplicate_trashed"}


def test_gate_on_a_stream(spark, tmp_path):
    scans = bind(spark, SF).folder_scans.select("scan", "path", "fingerprint")
    last = scans.agg(F.max("scan")).first()[0]
    cuts, states = [0, last // 3, 2 * last // 3, last + 1], []
    for low, high in zip(cuts, cuts[1:]):  # the stream is started anew for each third and goes on from its checkpoint
        scans.where(F.col("scan").between(low, high - 1)).coalesce(2).write.parquet(str(tmp_path / f"in/batch={low:010d}"))
        stream = spark.readStream.schema(jobs.SIGHTINGS).parquet(str(tmp_path / "in/*"))
        query = jobs.release(stream, 2, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert query.awaitTermination(120)
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, files.stability_gate(scans, 2).select("path", "fingerprint", "released_at").collect())) and got
    assert min(states) < scans.select("path").distinct().count()  # vanished paths leave the state


def test_scans_of_a_folder(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "whole.epub").write_bytes(b"1")
    for scan in range(3):
        (box / "growing.epub").write_bytes(b"x" * (scan + 1))
        (box / "half.epub.part").write_bytes(b"x")
        jobs.record_scan(spark, str(box), scan, str(tmp_path / "seen"))
    jobs.record_scan(spark, str(box), 2, str(tmp_path / "seen"))  # a repeated scan replaces itself
    stream = spark.readStream.schema(jobs.SIGHTINGS).parquet(str(tmp_path / "seen/*"))
    assert jobs.release(stream, 2, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = [(os.path.basename(r.path), r.released_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("whole.epub", 1)]


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    snap, box = tmp_path / "snap", str(tmp_path / "in")
    rows = spark.range(400).selectExpr("id % 40 AS user_id", "id AS asset_id", "0.5D AS progress", "'d' AS device_id", "id AS modified_at", "id AS seq")
    parts = [rows, rows.where("asset_id = 7").withColumn("seq", F.col("seq") + 1), rows.where("asset_id IN (7, 8)").withColumn("seq", F.col("seq") + 2)]
    written, whole = [], None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(box)
        stream = spark.readStream.schema(rows.schema).parquet(box)
        assert jobs.position_snapshot(stream, str(snap), str(tmp_path / "ck"), buckets=16).awaitTermination(120)
        written.append({p.parent.name for p in snap.glob(f"files/epoch={len(written)}/*/*.parquet")})
        whole = part if whole is None else whole.unionByName(part)
        got, want = jobs.read_snapshot(spark, str(snap)), jobs.merge_positions(None, whole)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert len(written[0]) == 16 and len(written[1]) == 1 and len(written[2]) in (1, 2) and written[1] <= written[2]
    assert jobs.latest_version(spark, str(snap)) == 2 and len(list((snap / "versions").glob("0*"))) == 2
    # The bucket of asset 7 in the first batch's files is named by no kept version.
    assert {p.name for p in (snap / "files/epoch=0").glob("bucket=*")} == written[0] - written[1]
    assert jobs.read_snapshot(spark, str(snap), 1).where("asset_id = 7").first().revision == 2
