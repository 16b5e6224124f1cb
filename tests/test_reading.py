"""Session, day and late-data cases with known outcomes."""

from pyspark.sql import functions as F

from foliant.operators import reading

MIN = 60_000
EVENT = ("user_id long, source_id string, kind string, segment long, elapsed_ms long, last_activity_ms long, finished boolean, "
         "received_at long, seq long")


def totals(spark, rows):
    events = spark.createDataFrame([(1, *row, i) for i, row in enumerate(rows)], EVENT)
    return {r.source_id: (r.counted_ms, r.closed_at) for r in reading.session_totals(reading.reading_sessions(events)).collect()}


def test_retries_and_takeover(spark):
    got = totals(spark, [
        ("a", "start", 0, 0, 0, False, 0), ("a", "checkpoint", 0, 60_000, 60_000, False, 60_000), ("a", "checkpoint", 0, 60_000, 60_000, False, 61_000),
        ("a", "checkpoint", 0, 30_000, 30_000, False, 62_000), ("b", "start", 0, 0, 0, False, 90_000),
        ("a", "checkpoint", 0, 120_000, 120_000, True, 130_000), ("b", "checkpoint", 0, 60_000, 60_000, False, 150_000)])
    assert got == {"a": (90_000, 90_000), "b": (60_000, None)}


def test_idle_and_late_action(spark):
    got = totals(spark, [
        ("a", "start", 0, 0, 0, False, 0), ("a", "checkpoint", 0, MIN, 0, False, MIN), ("a", "checkpoint", 0, 60 * MIN, 60 * MIN, False, 60 * MIN)])
    assert got == {"a": (5 * MIN, 5 * MIN)}
    got = totals(spark, [("a", "start", 0, 0, 0, False, 0), ("a", "checkpoint", 0, 310_000, 290_000, False, 310_000)])
    assert got == {"a": (310_000, None)}


def test_hidden_gap_is_skipped(spark):
    got = totals(spark, [
        ("a", "start", 0, 0, 0, False, 0), ("a", "checkpoint", 0, MIN, MIN, False, MIN), ("a", "start", 1, 0, 0, False, 3 * MIN),
        ("a", "checkpoint", 0, 2 * MIN, 2 * MIN, False, 3 * MIN + 1), ("a", "checkpoint", 1, MIN, MIN, False, 4 * MIN)])
    assert got == {"a": (2 * MIN, None)}


def test_local_days(spark):
    def ms(text):
        return spark.sql(f"SELECT unix_millis(timestamp '{text}+00:00') AS m").first().m

    spans = spark.createDataFrame([
        (1, "America/Sao_Paulo", ms("2018-11-04 02:59:30"), ms("2018-11-04 03:00:30")),
        (2, "America/Havana", ms("2026-11-01 03:59:30"), ms("2026-11-01 04:00:30")),
        (3, "Pacific/Apia", ms("2011-12-30 09:59:30"), ms("2011-12-30 10:00:30")),
        (4, "America/New_York", ms("2026-03-08 05:00:00"), ms("2026-03-09 04:00:00")),
        (5, "America/New_York", ms("2026-11-01 04:00:00"), ms("2026-11-02 05:00:00"))], "id long, time_zone string, span_from long, span_to long")
    got = {(r.id, r.day): r.active_ms for r in reading.session_days(spans, ["id"]).collect()}
    assert got == {(1, "2018-11-03"): 30_000, (1, "2018-11-04"): 30_000, (2, "2026-10-31"): 30_000, (2, "2026-11-01"): 30_000,
                   (3, "2011-12-29"): 30_000, (3, "2011-12-31"): 30_000, (4, "2026-03-08"): 23 * 3_600_000, (5, "2026-11-01"): 25 * 3_600_000}


def test_late_bookmarks(spark):
    rows = [(100, 0.8, "p1"), (200, 0.2, "p2"), (150, 0.9, "p3"), (200, 0.2, "p2")]
    updates = spark.createDataFrame([(1, 7, i, 1000 + i, at, p, a, "", 0) for i, (at, p, a) in enumerate(rows)],
                                    "user_id long, asset_id long, seq long, arrived_at long, modified_at long, progress double, address string, status string, status_at long")
    got = [(r.moved, r.revision) for r in reading.late_updates(updates).orderBy("seq").collect()]
    assert got == [(True, 1), (True, 2), (False, 2), (False, 2)]


def test_status_rule(spark):
    df = spark.createDataFrame([("unread", 0.1), ("reading", 0.995), ("dropped", 1.0), ("finished", 0.2)], "s string, p double")
    out = [r[0] for r in df.select(reading.status_after_progress(F.col("s"), F.col("p"))).collect()]
    assert out == ["reading", "finished", "dropped", "finished"]
