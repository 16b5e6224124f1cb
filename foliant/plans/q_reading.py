"""Reading activity, sync and feeds, with their SQL twins (sequential rules as recursive queries)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import feed, reading
from foliant.plans.bindings import BINDINGS, ORACLE_ONLY
from foliant.plans.registry import query
from foliant.session import ensure_checkpoint_dir
from foliant.sources.catalog import Catalog
from foliant.streaming import jobs

IDLE = 12 * 3600 * 1000  # the provided events are hours apart; the library default is five minutes

BINDINGS["session_raw"] = """
SELECT user_id + 1 AS user_id, CAST(user_id AS STRING) || '-' || CAST(CAST(floor(@MILLIS(ts) / 259200000) AS BIGINT) AS STRING) AS source_id,
       @MILLIS(ts) AS at_ms, event_id AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}
"""
BINDINGS["session_events"] = """
SELECT r.user_id, r.source_id, CASE WHEN r.at_ms = f.first_ms THEN 'start' WHEN r.k % 7 = 0 THEN 'start' ELSE 'checkpoint' END AS kind,
       CASE WHEN r.at_ms = f.first_ms THEN CAST(0 AS BIGINT) WHEN r.k % 7 = 0 THEN CAST(1 AS BIGINT) WHEN r.k % 5 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS segment,
       r.at_ms - f.first_ms - r.k * 1000 AS elapsed_ms, greatest(r.at_ms - f.first_ms - r.k * 60000, CAST(0 AS BIGINT)) AS last_activity_ms,
       r.k % 10 = 3 AS finished, r.at_ms AS received_at, r.seq
FROM {session_raw} r JOIN (SELECT source_id, min(at_ms) AS first_ms FROM {session_raw} GROUP BY source_id) f ON f.source_id = r.source_id
"""
ORACLE_ONLY["session_rows"] = """
WITH starts AS (SELECT user_id, source_id, min(received_at) AS began FROM {session_events} WHERE kind = 'start' AND segment = 0 GROUP BY user_id, source_id),
t AS (SELECT user_id, source_id, lead(began) OVER (PARTITION BY user_id ORDER BY began, source_id DESC) AS upto FROM starts),
e AS (SELECT user_id, source_id, kind, segment, elapsed_ms, last_activity_ms, finished, received_at, seq FROM {session_events}
      UNION ALL SELECT user_id, source_id, 'takeover', 0, 0, 0, false, upto, -1 FROM t WHERE upto IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY user_id, source_id ORDER BY received_at, seq) AS n FROM e"""
ORACLE_ONLY["session_fold"] = f"""
WITH RECURSIVE f AS (
  SELECT user_id, source_id, n, received_at, CAST(segment AS BIGINT) AS segment, received_at AS seg_start, received_at AS observed, received_at AS active,
         CAST(0 AS BIGINT) AS counted, CAST(NULL AS BIGINT) AS closed, CAST(0 AS BIGINT) AS span_from, CAST(0 AS BIGINT) AS span_to, seq
  FROM {{session_rows}} WHERE n = 1
  UNION ALL
  SELECT user_id, source_id, n, received_at,
    CASE WHEN resume THEN new_segment ELSE segment END, CASE WHEN resume THEN greatest(received_at, observed) ELSE seg_start END,
    CASE WHEN resume THEN greatest(received_at, observed) WHEN chk THEN new_observed ELSE observed END,
    CASE WHEN resume THEN greatest(received_at, observed) WHEN chk THEN new_active ELSE active END,
    CASE WHEN chk THEN counted + new_observed - observed ELSE counted END,
    CASE WHEN kind = 'takeover' AND closed IS NULL THEN greatest(observed, least(received_at, active + {IDLE}))
         WHEN chk AND finished AND seg_start + elapsed >= new_observed THEN new_observed WHEN chk THEN new_closed ELSE closed END,
    CASE WHEN chk THEN observed ELSE 0 END, CASE WHEN chk THEN new_observed ELSE 0 END, seq
  FROM (
    SELECT *, greatest(observed, least(seg_start + elapsed, new_active + {IDLE}, coalesce(new_closed, 9000000000000000))) AS new_observed FROM (
      SELECT *, CASE WHEN seg_start + elapsed >= new_active + {IDLE} AND (closed IS NULL OR new_active + {IDLE} < closed) THEN new_active + {IDLE} ELSE closed END AS new_closed FROM (
        SELECT *, CASE WHEN seg_start + least(elapsed, last_activity_ms) < active + {IDLE} THEN greatest(active, seg_start + least(elapsed, last_activity_ms)) ELSE active END AS new_active FROM (
          SELECT f.user_id, f.source_id, e.n, e.received_at, e.kind, e.finished, e.last_activity_ms, e.seq, e.segment AS new_segment,
                 f.segment, f.seg_start, f.observed, f.active, f.counted, f.closed,
                 e.kind = 'checkpoint' AND e.segment = f.segment AS chk,
                 e.kind = 'start' AND e.segment > f.segment AND f.closed IS NULL AND e.received_at < f.active + {IDLE} AS resume,
                 least(e.elapsed_ms, greatest(0, e.received_at - f.seg_start)) AS elapsed
          FROM f JOIN {{session_rows}} e ON e.user_id = f.user_id AND e.source_id = f.source_id AND e.n = f.n + 1) a) b) c) d)
SELECT user_id, source_id, n, received_at, span_from, span_to, counted, closed, seq FROM f"""
query("reading_sessions", """
SELECT user_id, source_id, counted AS counted_ms, closed AS closed_at FROM {session_fold}
QUALIFY row_number() OVER (PARTITION BY user_id, source_id ORDER BY n DESC) = 1""")(
    lambda c: reading.session_totals(reading.reading_sessions(c.session_events, IDLE)))
query("reading_session_spans", "SELECT user_id, source_id, received_at, span_from, span_to FROM {session_fold} WHERE span_to > span_from")(
    lambda c: reading.reading_sessions(c.session_events, IDLE).where("span_to > span_from").select("user_id", "source_id", "received_at", "span_from", "span_to"))

ZONE = "CASE user_id % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Kolkata' WHEN 2 THEN 'America/Sao_Paulo' ELSE 'UTC' END"


def spans_with_zone(c: Catalog) -> DataFrame:
    return reading.reading_sessions(c.session_events, IDLE).where("span_to > span_from").withColumn("time_zone", F.expr(ZONE))


# Fixed offsets of the zones in January 2024, the month of the provided events.
OFFSET = "CASE user_id % 4 WHEN 0 THEN -18000000 WHEN 1 THEN 19800000 WHEN 2 THEN -10800000 ELSE 0 END"
query("session_days", f"""
WITH s AS (SELECT user_id, source_id, span_from + {OFFSET} AS a, span_to + {OFFSET} AS z, {OFFSET} AS off FROM {{session_fold}} WHERE span_to > span_from),
d AS (SELECT *, unnest(generate_series(a // 86400000, (z - 1) // 86400000)) AS day FROM s)
SELECT user_id, source_id, strftime(epoch_ms(CAST(day * 86400000 AS BIGINT)), '%Y-%m-%d') AS day,
       CAST(min(greatest(a, day * 86400000) - off) AS BIGINT) AS started_at, CAST(max(least(z, (day + 1) * 86400000) - off) AS BIGINT) AS ended_at,
       CAST(sum(least(z, (day + 1) * 86400000) - greatest(a, day * 86400000)) AS BIGINT) AS active_ms
FROM d GROUP BY user_id, source_id, day""")(lambda c: reading.session_days(spans_with_zone(c), ["user_id", "source_id"]))

# --- status ----------------------------------------------------------------------------
ORACLE_ONLY["status_events"] = """
WITH s AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id, book_id ORDER BY at_s, id), 'unread') AS from_status FROM {activity}),
c AS (SELECT * FROM s WHERE from_status <> status)
SELECT id, user_id, book_id, lag(id) OVER (PARTITION BY user_id, book_id ORDER BY at_s, id) AS previous_event_id, from_status, status AS to_status, source, at_s AS occurred_at FROM c"""


def status_events(c: Catalog) -> DataFrame:
    return reading.reading_status(c.activity.select("id", "user_id", "book_id", "status", "source", "at_s"))


query("reading_status", "SELECT id, user_id, book_id, previous_event_id, from_status, to_status, source, occurred_at FROM {status_events}")(status_events)
query("reading_status_current", """
SELECT user_id, book_id, to_status AS status, id AS last_event_id, occurred_at AS updated_at FROM {status_events}
QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY occurred_at DESC, id DESC) = 1""")(lambda c: reading.current_status(status_events(c)))
query("status_after_progress", """
SELECT id, CASE WHEN status IN ('unread', 'reading') THEN CASE WHEN progress >= 0.995 THEN 'finished' ELSE 'reading' END ELSE status END AS status FROM {activity}""")(
    lambda c: c.activity.select("id", reading.status_after_progress(F.col("status"), F.col("progress")).alias("status")))
ORACLE_ONLY["mixed_rows"] = "SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY at_s, id) AS n FROM {activity}"
query("status_with_progress", """
WITH RECURSIVE f AS (
  SELECT user_id, book_id, n, CASE WHEN source = 'manual' THEN status WHEN progress >= 0.995 THEN 'finished' ELSE 'reading' END AS state FROM {mixed_rows} WHERE n = 1
  UNION ALL
  SELECT f.user_id, f.book_id, e.n, CASE WHEN e.source = 'manual' THEN e.status WHEN f.state IN ('finished', 'dropped') THEN f.state
                                         WHEN e.progress >= 0.995 THEN 'finished' ELSE 'reading' END
  FROM f JOIN {mixed_rows} e ON e.user_id = f.user_id AND e.book_id = f.book_id AND e.n = f.n + 1)
SELECT user_id, book_id, state AS status FROM f QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY n DESC) = 1""")(
    lambda c: reading.status_with_progress(c.activity))


def undo(c: Catalog) -> DataFrame:
    events = status_events(c).withColumn("reverted_at", F.when(F.col("id") % 11 == 0, F.col("occurred_at")))
    state = reading.current_status(status_events(c))
    requests = events.where("id % 3 = 0 OR to_status = 'finished'").select("user_id", "book_id", F.col("id").alias("event_id"))
    return reading.undo_status(requests, events, state)


query("undo_status", """
WITH st AS (SELECT user_id, book_id, to_status AS status, id AS last_event_id FROM {status_events} QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY occurred_at DESC, id DESC) = 1),
r AS (SELECT e.*, st.status, st.last_event_id, st.last_event_id = e.id AND e.id % 11 <> 0 AND e.to_status = 'finished' AND e.source <> 'manual' AS undone
      FROM {status_events} e JOIN st ON st.user_id = e.user_id AND st.book_id = e.book_id WHERE e.id % 3 = 0 OR e.to_status = 'finished')
SELECT user_id, book_id, id AS event_id, undone, CASE WHEN undone THEN from_status ELSE status END AS status,
       CASE WHEN undone THEN previous_event_id ELSE last_event_id END AS last_event_id FROM r""")(undo)

# --- positions and sync ------------------------------------------------------------------
ORACLE_ONLY["sync_rows"] = "SELECT *, row_number() OVER (PARTITION BY user_id, asset_id ORDER BY arrived_at, seq) AS n FROM {sync_writes}"
query("latest_position", """
WITH s AS (SELECT *, is_reset AND coalesce(lag(is_reset) OVER (PARTITION BY user_id, asset_id ORDER BY n), false) AS idle FROM {sync_rows})
SELECT user_id, asset_id, max_by(CASE WHEN NOT is_reset THEN progress END, n) FILTER (NOT is_reset) AS p0,
       CASE WHEN max_by(is_reset, n) THEN NULL ELSE max_by(progress, n) END AS progress,
       CASE WHEN max_by(is_reset, n) THEN '' ELSE max_by(device_id, n) END AS device_id, count(*) AS revision, max_by(arrived_at, n) AS updated_at
FROM s WHERE NOT idle GROUP BY user_id, asset_id""".replace("max_by(CASE WHEN NOT is_reset THEN progress END, n) FILTER (NOT is_reset) AS p0,\n       ", ""))(
    lambda c: reading.latest_position(c.sync_writes))


def positions_of_a_stream(c: Catalog) -> DataFrame:
    """The newest position of each asset, kept up by a stream that is started twice; the second batch rewrites its buckets."""
    writes = c.sync_writes.select("user_id", "asset_id", "progress", "device_id", "modified_at", "seq")
    place = f"{ensure_checkpoint_dir(c.spark)}/positions-{uuid.uuid4().hex}"
    for part, rows in (("early", writes.where("device_id <> 'd2'")), ("late", writes.where("device_id = 'd2'"))):
        rows.write.parquet(f"{place}/in/{part}")
        stream = c.spark.readStream.schema(rows.schema).parquet(f"{place}/in/*")
        jobs.position_snapshot(stream, f"{place}/out", f"{place}/state").awaitTermination()
    return jobs.read_snapshot(c.spark, f"{place}/out")


query("position_snapshot", """
SELECT user_id, asset_id, max_by(progress, t) AS progress, max_by(device_id, t) AS device_id, max(modified_at) AS modified_at, max_by(seq, t) AS seq, count(*) AS revision
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, asset_id ORDER BY modified_at, seq) AS t FROM {sync_writes}) w GROUP BY user_id, asset_id""")(positions_of_a_stream)
for _mode, _named in (("revision", "expected_revision"), ("stamp", "CAST(NULL AS BIGINT)"), ("mixed", "CASE WHEN seq % 3 = 0 THEN expected_revision END")):
    ORACLE_ONLY[f"conflicts_{_mode}"] = f"""
WITH RECURSIVE f AS (
  SELECT user_id, asset_id, n, seq, outcome, CASE WHEN outcome = 'accepted' THEN progress ELSE 0.0 END AS progress, CASE WHEN outcome = 'accepted' THEN address ELSE '' END AS address,
         CASE WHEN outcome = 'accepted' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS revision, CASE WHEN outcome = 'accepted' THEN arrived_at ELSE CAST(0 AS BIGINT) END AS updated
  FROM (SELECT *, CASE WHEN coalesce({_named} <> 0, false) THEN 'conflict' ELSE 'accepted' END AS outcome FROM {{sync_rows}} WHERE n = 1) x
  UNION ALL
  SELECT user_id, asset_id, n, seq, outcome, CASE WHEN outcome = 'accepted' THEN np ELSE progress END, CASE WHEN outcome = 'accepted' THEN na ELSE address END,
         CASE WHEN outcome = 'accepted' THEN revision + 1 ELSE revision END, CASE WHEN outcome = 'accepted' THEN arrived_at ELSE updated END
  FROM (SELECT f.user_id, f.asset_id, e.n, e.seq, f.progress, f.address, f.revision, f.updated, e.progress AS np, e.address AS na, e.arrived_at,
               CASE WHEN f.revision > 0 AND e.progress = f.progress AND e.address = f.address THEN 'same' WHEN coalesce(e.named <> f.revision, f.revision > 0 AND e.progress < f.progress AND e.modified_at < f.updated - 300) THEN 'conflict' ELSE 'accepted' END AS outcome
        FROM f JOIN (SELECT *, {_named} AS named FROM {{sync_rows}}) e ON e.user_id = f.user_id AND e.asset_id = f.asset_id AND e.n = f.n + 1) y)
SELECT user_id, asset_id, seq, outcome, revision FROM f"""
    query(f"position_conflicts_{_mode}", f"SELECT user_id, asset_id, seq, outcome, revision FROM {{conflicts_{_mode}}}")(
        lambda c, named=_named: reading.position_conflicts(c.sync_writes.withColumn("expected_revision", F.expr(named))).select("user_id", "asset_id", "seq", "outcome", "revision"))


def written_status(c: Catalog) -> DataFrame:
    """Assets 1 to 40 stand for the books of the same numbers."""
    outcomes = reading.position_conflicts(c.sync_writes).select("user_id", F.col("asset_id").alias("book_id"), "progress", "outcome")
    return reading.status_after_writes(outcomes, c.reading_state)


query("status_after_writes", """
WITH m AS (SELECT c.user_id, c.asset_id AS book_id, max(w.progress) AS reached FROM {conflicts_revision} c JOIN {sync_writes} w ON w.seq = c.seq AND w.user_id = c.user_id AND w.asset_id = c.asset_id
           WHERE c.outcome = 'accepted' GROUP BY c.user_id, c.asset_id)
SELECT coalesce(m.user_id, s.user_id) AS user_id, coalesce(m.book_id, s.book_id) AS book_id,
       CASE WHEN m.reached IS NULL OR s.status IN ('finished', 'dropped') THEN s.status WHEN m.reached >= 0.995 THEN 'finished' ELSE 'reading' END AS status
FROM m FULL OUTER JOIN {reading_state} s ON s.user_id = m.user_id AND s.book_id = m.book_id""")(written_status)
BINDINGS["cached_locators"] = """
SELECT user_id, asset_id, CASE WHEN user_id % 2 = 0 THEN revision ELSE revision + 1 END AS revision, 'cfi' || CAST(asset_id AS STRING) AS locator FROM {reading_positions}
"""
query("fill_position_cache", """
SELECT p.user_id, p.asset_id, p.revision, CASE WHEN p.asset_id % 3 = 0 AND p.user_id % 2 = 0 THEN 'cfi' || CAST(p.asset_id AS STRING)
       WHEN p.asset_id % 3 = 0 THEN '{{}}' ELSE p.locator END AS locator FROM {reading_positions} p""")(
    lambda c: reading.fill_position_cache(c.reading_positions.withColumn("locator", F.expr("CASE WHEN asset_id % 3 = 0 THEN '{}' ELSE locator END")), c.cached_locators))

BINDINGS["uploads"] = """
SELECT user_id, 'doc' || CAST(asset_id AS STRING) AS document, device_id, address, arrived_at, seq, arrived_at > 900000000 AS known FROM {sync_writes}
"""
ORACLE_ONLY["upload_rows"] = """
SELECT *, row_number() OVER (PARTITION BY user_id, document ORDER BY arrived_at, seq) AS n,
       lag(address) OVER (PARTITION BY user_id, document, device_id ORDER BY arrived_at, seq) AS device_last FROM {uploads}"""
query("sync_uploads", """
WITH RECURSIVE f AS (
  SELECT user_id, document, n, seq, 'saved' AS outcome, address AS current_address, known AS on_asset FROM {upload_rows} WHERE n = 1
  UNION ALL
  SELECT user_id, document, n, seq, CASE WHEN changed THEN 'saved' WHEN known AND NOT on_asset THEN 'adopted' ELSE 'ignored' END,
         CASE WHEN changed THEN address ELSE current_address END, on_asset OR known
  FROM (SELECT f.user_id, f.document, e.n, e.seq, e.address, e.known, f.on_asset, f.current_address,
               e.device_last IS DISTINCT FROM e.address AND f.current_address <> e.address AS changed
        FROM f JOIN {upload_rows} e ON e.user_id = f.user_id AND e.document = f.document AND e.n = f.n + 1) x)
SELECT user_id, document, seq, outcome, current_address FROM f""")(
    lambda c: reading.sync_uploads(c.uploads).select("user_id", "document", "seq", "outcome", "current_address"))
query("resolve_document", """
SELECT h.sampled_hash AS hash, CASE WHEN count(*) = 1 THEN min(h.id) ELSE 0 END AS asset_id, CASE WHEN count(DISTINCT h.book_id) = 1 THEN min(h.book_id) ELSE 0 END AS book_id
FROM {assets} h JOIN {books} b ON b.id = h.book_id AND b.deleted_at IS NULL WHERE h.sampled_hash IS NOT NULL GROUP BY h.sampled_hash""")(
    lambda c: reading.resolve_document(c.assets.where("sampled_hash IS NOT NULL").select(F.col("id").alias("asset_id"), F.col("sampled_hash").alias("hash")), c.assets, c.books))

BINDINGS["bookmarks"] = """
SELECT user_id, asset_id, seq, arrived_at, modified_at, CASE WHEN seq % 7 <> 3 THEN progress END AS progress,
       CASE WHEN seq % 11 = 4 THEN NULL WHEN seq % 5 = 1 THEN '' ELSE address END AS address,
       CASE seq % 9 WHEN 0 THEN 'dropped' WHEN 1 THEN 'finished' WHEN 2 THEN 'reading' ELSE '' END AS status, modified_at - 86400 AS status_at FROM {sync_writes}
"""
ORACLE_ONLY["bookmark_rows"] = "SELECT *, row_number() OVER (PARTITION BY user_id, asset_id ORDER BY arrived_at, seq) AS n, least(modified_at, arrived_at) AS stamp FROM {bookmarks}"
query("late_updates", """
WITH RECURSIVE f AS (
  SELECT user_id, asset_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, '' AS address, CAST(0 AS DOUBLE) AS progress, CAST(0 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS updated,
         'unread' AS state, CAST(0 AS BIGINT) AS state_at, false AS moved, false AS status_changed FROM {bookmark_rows} WHERE n = 1
  UNION ALL
  SELECT user_id, asset_id, n, seq, CASE WHEN moved THEN na ELSE address END, CASE WHEN moved THEN np ELSE progress END, CASE WHEN moved THEN revision + 1 ELSE revision END,
         CASE WHEN moved THEN stamp ELSE updated END, CASE WHEN ch THEN target ELSE state END, CASE WHEN ch THEN at ELSE state_at END, moved, ch
  FROM (SELECT *, (status <> '' OR moved) AND at >= state_at AND NOT (state = 'dropped' AND target = 'reading') AND target <> state AS ch
        FROM (SELECT *, CASE WHEN status <> '' THEN status WHEN state NOT IN ('unread', 'reading') THEN state WHEN (CASE WHEN moved THEN np ELSE progress END) >= 0.995 THEN 'finished' ELSE 'reading' END AS target,
                     CASE WHEN status <> '' THEN least(status_at, arrived_at) ELSE stamp END AS at
              FROM (SELECT f.user_id, f.asset_id, e.n, e.seq, f.address, f.progress, f.revision, f.updated, f.state, f.state_at, e.address AS na, coalesce(e.progress, f.progress) AS np, e.stamp, e.status, e.status_at, e.arrived_at,
                           e.address IS NOT NULL AND NOT coalesce(f.revision > 0 AND f.address = e.address AND (e.address <> '' OR coalesce(e.progress, f.progress) = f.progress), false)
                             AND (f.revision = 0 OR e.stamp >= f.updated) AS moved
                    FROM f JOIN {bookmark_rows} e ON e.user_id = f.user_id AND e.asset_id = f.asset_id AND e.n = f.n + 1) x) y) z)
SELECT user_id, asset_id, seq, moved, status_changed, revision, state FROM f WHERE n > 0""".replace(" AS at\n", " AS at_\n").replace("THEN at ELSE", "THEN at_ ELSE").replace("AND at >= state_at", "AND at_ >= state_at"))(
    lambda c: reading.late_updates(c.bookmarks).select("user_id", "asset_id", "seq", "moved", "status_changed", "revision", "state"))

BINDINGS["annotation_ops"] = """
SELECT user_id, asset_id, address AS selection, arrived_at AS at_s, seq, CASE seq % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS op,
       CAST(1 + expected_revision % 4 AS BIGINT) AS revision, 'n' || CAST(seq % 3 AS STRING) AS note, CASE WHEN seq % 2 = 0 THEN 'yellow' ELSE 'blue' END AS color FROM {sync_writes}
"""
ORACLE_ONLY["op_rows"] = "SELECT *, row_number() OVER (PARTITION BY user_id, asset_id, selection ORDER BY at_s, seq) AS n FROM {annotation_ops}"
query("annotation_log", """
WITH RECURSIVE f AS (
  SELECT user_id, asset_id, selection, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS gen, CAST(0 AS BIGINT) AS rev, false AS live, '' AS note, '' AS color, '' AS outcome
  FROM {op_rows} WHERE n = 1
  UNION ALL
  SELECT user_id, asset_id, selection, n, seq, CASE WHEN o = 'created' THEN gen + 1 ELSE gen END,
         CASE WHEN o = 'created' THEN 1 WHEN o IN ('updated', 'deleted') THEN rev + 1 ELSE rev END,
         CASE WHEN o = 'created' THEN true WHEN o = 'deleted' THEN false ELSE live END,
         CASE WHEN o IN ('created', 'updated') THEN nn WHEN o = 'deleted' THEN '' ELSE note END, CASE WHEN o IN ('created', 'updated') THEN nc ELSE color END, o
  FROM (SELECT f.user_id, f.asset_id, f.selection, e.n, e.seq, f.gen, f.rev, f.live, f.note, f.color, e.note AS nn, e.color AS nc,
          CASE WHEN e.op = 'create' THEN CASE WHEN f.live THEN 'exists' ELSE 'created' END WHEN f.gen = 0 THEN 'missing'
               WHEN e.op = 'delete' THEN CASE WHEN NOT f.live THEN 'gone' WHEN e.revision <> f.rev THEN 'conflict' ELSE 'deleted' END
               WHEN NOT f.live THEN 'conflict' WHEN e.note = f.note AND e.color = f.color THEN 'applied' WHEN e.revision <> f.rev THEN 'conflict' ELSE 'updated' END AS o
        FROM f JOIN {op_rows} e ON e.user_id = f.user_id AND e.asset_id = f.asset_id AND e.selection = f.selection AND e.n = f.n + 1) x)
SELECT user_id, asset_id, selection, seq, outcome, gen AS generation, rev AS new_revision FROM f WHERE n > 0""")(
    lambda c: reading.annotation_log(c.annotation_ops).select("user_id", "asset_id", "selection", "seq", "outcome", "generation", "new_revision"))
ORACLE_ONLY["use_rows"] = "SELECT token, at_s, row_number() OVER (PARTITION BY token ORDER BY at_s) AS n FROM (SELECT DISTINCT user_id AS token, at_s FROM {activity}) d"
query("touch_throttle", """
WITH RECURSIVE f AS (
  SELECT token, n, at_s AS last, CAST(1 AS BIGINT) AS writes FROM {use_rows} WHERE n = 1
  UNION ALL SELECT f.token, e.n, CASE WHEN e.at_s - f.last >= 43200 THEN e.at_s ELSE f.last END, CASE WHEN e.at_s - f.last >= 43200 THEN f.writes + 1 ELSE f.writes END
  FROM f JOIN {use_rows} e ON e.token = f.token AND e.n = f.n + 1)
SELECT token, last AS last_used_at, writes FROM f QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC) = 1""")(
    lambda c: reading.touch_throttle(c.activity.select(F.col("user_id").alias("token"), "at_s"), 43200))

# --- feeds -------------------------------------------------------------------------------
BINDINGS["feed_shelf_rows"] = """
SELECT shelf_id AS connection_id, shelf_id + 1 AS user_id, book_id FROM {shelf_books}
"""
ORACLE_ONLY["candidates"] = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY format <> 'kepub', NOT is_primary, created_at, id) AS n FROM {assets} WHERE format IN ('kepub', 'epub')),
c AS (SELECT ba.book_id, string_agg(x.name, chr(31) ORDER BY ba.author_order, translate(x.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), x.id) AS authors
      FROM {book_authors} ba JOIN {authors} x ON x.id = ba.author_id GROUP BY ba.book_id)
SELECT s.connection_id, a.id AS asset_id, s.book_id, substr(sha256(concat_ws('|', a.id, b.id, a.format, coalesce(a.current_size, a.original_size, 0), b.title, coalesce(b.description, ''),
  coalesce(b.publisher, ''), coalesce(b.published_date, ''), coalesce(b.language, ''), coalesce(b.series, ''), coalesce(CAST(CAST(b.series_index AS BIGINT) AS VARCHAR), ''), b.added_at,
  greatest(b.updated_at, a.updated_at), b.cover_version, coalesce(c.authors, ''), coalesce(p.revision, 0), coalesce(r.last_event_id, 0))), 1, 32) AS fingerprint
FROM {feed_shelf_rows} s JOIN {books} b ON b.id = s.book_id AND b.deleted_at IS NULL JOIN a ON a.book_id = b.id AND a.n = 1 LEFT JOIN c ON c.book_id = b.id
LEFT JOIN {reading_positions} p ON p.user_id = s.user_id AND p.asset_id = a.id LEFT JOIN {reading_state} r ON r.user_id = s.user_id AND r.book_id = b.id"""


def candidates(c: Catalog) -> DataFrame:
    return feed.feed_candidates(c.feed_shelf_rows, c.books, c.assets, c.authors, c.book_authors, c.reading_positions, c.reading_state)


query("feed_candidates", "SELECT connection_id, asset_id, book_id, fingerprint FROM {candidates}")(candidates)
# The feed as last sent: some assets known, some changed since, some gone, some tombstones.
BINDINGS["feed_items"] = """
SELECT s.connection_id, a.id AS asset_id, a.book_id, md5(CAST(a.id AS STRING)) AS fingerprint, a.id % 5 <> 0 AS present,
       a.id % 1000 + 1 AS revision, a.id % 100 + 1 AS first_revision
FROM {feed_shelf_rows} s JOIN {assets} a ON a.book_id = s.book_id WHERE a.format IN ('kepub', 'epub', 'pdf') AND a.id % 3 = 0
"""
query("shelf_change_feed", """
WITH b AS (SELECT coalesce(o.connection_id, n.connection_id) AS connection_id, coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(n.book_id, o.book_id) AS book_id,
             coalesce(n.fingerprint, o.fingerprint) AS fingerprint, o.first_revision,
             CASE WHEN o.asset_id IS NULL THEN 'add' WHEN n.asset_id IS NULL AND o.present THEN 'remove' WHEN n.asset_id IS NOT NULL AND NOT o.present THEN 'return'
                  WHEN n.fingerprint <> o.fingerprint THEN 'change' END AS kind
           FROM {feed_items} o FULL OUTER JOIN {candidates} n ON n.connection_id = o.connection_id AND n.asset_id = o.asset_id),
r AS (SELECT *, CAST(5000 + connection_id + row_number() OVER (PARTITION BY connection_id ORDER BY kind = 'remove', asset_id) AS BIGINT) AS revision FROM b WHERE kind IS NOT NULL)
SELECT connection_id, asset_id, book_id, kind, fingerprint, kind <> 'remove' AS present, revision, CASE WHEN kind IN ('add', 'return') THEN revision ELSE first_revision END AS first_revision FROM r""")(
    lambda c: feed.shelf_change_feed(c.feed_items, candidates(c), c.feed_shelf_rows.select("connection_id", (F.col("connection_id") + 5000).alias("revision")).distinct(),
        feed.id_width(c.assets)))
query("feed_page", """
WITH t AS (SELECT *, row_number() OVER (ORDER BY revision) AS n FROM (SELECT f.*, asset_id * 7 AS rev FROM {feed_items} f WHERE connection_id = 8) x)
SELECT CAST(rn AS BIGINT) AS rn, asset_id, book_id, revision, first_revision, present, title, format, more FROM (
  SELECT row_number() OVER (ORDER BY i.asset_id) AS rn, i.asset_id, i.book_id, i.asset_id AS revision, i.first_revision, i.present, coalesce(b.title, '') AS title, coalesce(a.format, '') AS format,
         count(*) OVER () > 50 AS more
  FROM {feed_items} i LEFT JOIN {books} b ON b.id = i.book_id LEFT JOIN {assets} a ON a.id = i.asset_id WHERE i.connection_id = 8 AND i.asset_id > 5000000000000) q WHERE rn <= 50""".replace(
    "WITH t AS (SELECT *, row_number() OVER (ORDER BY revision) AS n FROM (SELECT f.*, asset_id * 7 AS rev FROM {feed_items} f WHERE connection_id = 8) x)\n", ""))(
    lambda c: feed.feed_page(c.feed_items.withColumn("revision", F.col("asset_id")), c.books, c.assets, 8, 5000000000000, 50))
query("feed_asset_access", """
SELECT i.connection_id, i.asset_id, a.book_id FROM {feed_items} i JOIN {assets} a ON a.id = i.asset_id JOIN {books} b ON b.id = a.book_id AND b.deleted_at IS NULL WHERE i.present""")(
    lambda c: feed.feed_asset_access(c.feed_items, c.assets, c.books).select("connection_id", "asset_id", "book_id"))

# --- delivery queue ------------------------------------------------------------------------
BINDINGS["delivery_jobs"] = """
SELECT o_orderkey AS id, o_custkey % (SELECT greatest(20, CAST(floor(count(*) / 75) AS BIGINT)) FROM {customer}) + 1 AS user_id, @EPOCH(o_orderdate) AS created_at, '' AS error,
       CASE o_orderkey % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'converting' WHEN 2 THEN 'sending' WHEN 3 THEN 'failed' ELSE 'sent' END AS status FROM {orders}
"""
query("delivery_next", "SELECT id FROM {delivery_jobs} WHERE status = 'queued' ORDER BY created_at, id LIMIT 1")(lambda c: feed.next_delivery(c.delivery_jobs))
query("delivery_recover", """
SELECT id, user_id, CASE status WHEN 'converting' THEN 'queued' WHEN 'sending' THEN 'failed' ELSE status END AS status,
       CASE status WHEN 'sending' THEN 'Delivery was interrupted while sending; the message may have been sent.' ELSE '' END AS error FROM {delivery_jobs}""")(
    lambda c: feed.recover_deliveries(c.delivery_jobs))
query("delivery_prune", """
SELECT id, user_id, status FROM {delivery_jobs} WHERE id NOT IN (
  SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM {delivery_jobs} WHERE status IN ('sent', 'failed')) q WHERE n > 100)""")(
    lambda c: feed.prune_deliveries(c.delivery_jobs, 100).select("id", "user_id", "status"))
query("delivery_recent", """
SELECT CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS BIGINT) AS rn, id, user_id, status FROM {delivery_jobs} WHERE user_id = 7 QUALIFY rn <= 20""")(
    lambda c: feed.recent_deliveries(c.delivery_jobs, 7).select("rn", "id", "user_id", "status"))
BINDINGS["delivery_devices"] = """
SELECT o_orderkey AS id, o_custkey + 1 AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'kindle' WHEN 1 THEN 'pocketbook' ELSE 'generic' END AS preset,
       o_orderkey % 20 = 0 AS is_default, @EPOCH(o_orderdate) AS created_at FROM {orders}
"""
query("default_device", """
SELECT user_id, id AS device_id FROM {delivery_devices} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, created_at DESC, id DESC) = 1""")(
    lambda c: feed.default_device(c.delivery_devices))
