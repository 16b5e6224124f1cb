"""Ingest, exports, integrity audit, provider matching and delivery, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import audit, matching
from foliant.plans.bindings import BINDINGS, ORACLE_ONLY
from foliant.plans.registry import query
from foliant.session import cut_lineage, ensure_checkpoint_dir, fine_shuffles
from foliant.sources import exports, files
from foliant.sources.catalog import Catalog
from foliant.streaming import jobs

# A folder tree with one group folder per third book and loose files elsewhere.
BINDINGS["listing"] = """
SELECT 'lib/' || CAST(book_id AS STRING) || '/' || filename AS path, original_size AS size, created_at AS mtime FROM {assets}
UNION ALL SELECT 'lib/' || CAST(id AS STRING) || '/metadata.opf', CAST(10 AS BIGINT), added_at FROM {books} WHERE id % 3 = 0
UNION ALL SELECT 'lib/' || CAST(id AS STRING) || '/notes.doc', CAST(10 AS BIGINT), added_at FROM {books} WHERE id % 2 = 0
UNION ALL SELECT 'lib/' || CAST(id AS STRING) || '/extra/more.epub', CAST(10 AS BIGINT), added_at FROM {books} WHERE id % 5 = 0
"""
query("scan_folder", """
WITH r AS (SELECT path, CAST(split_part(path, '/', 2) AS BIGINT) AS book, path LIKE '%/extra/%' AS deep, NOT regexp_matches(path, '\\.(epub|kepub|pdf|fb2|mobi|txt)$') AS unknown FROM {listing})
SELECT path, CASE WHEN book % 3 = 0 THEN 'lib/' || CAST(book AS VARCHAR) ELSE path END AS source_group, book % 3 = 0 AS is_group, unknown AS skipped
FROM r WHERE book % 3 <> 0 OR (NOT deep AND NOT unknown)""")(lambda c: files.scan_folder(c.listing))
query("intake_candidates", """
SELECT path, NOT (ends_with(path, 'metadata.opf') OR regexp_extract(path, '([0-9]+)[.][a-z0-9]+$', 1) IN ('1', '2')) AS wanted FROM {listing}""")(
    lambda c: c.listing.select("path", files.intake_candidate(F.regexp_replace(F.regexp_replace("path", r"/(1\.[a-z0-9]+)$", "/.$1"), r"/(2\.[a-z0-9]+)$", "/$1.PART")).alias("wanted")))

BINDINGS["import_candidates"] = """
SELECT id, CASE WHEN id % 4 = 0 THEN original_size + 9000000000 WHEN id % 4 = 1 THEN coalesce(current_size, original_size) ELSE original_size END AS size,
       CASE WHEN id % 4 = 1 THEN current_hash WHEN id % 4 = 2 THEN md5('fresh ' || CAST(book_id AS STRING)) ELSE original_hash END AS hash FROM {assets}
"""
query("dedupe_import", """
SELECT i.id, CASE WHEN i.id % 4 IN (0, 2) THEN CASE WHEN i.id = min(i.id) OVER (PARTITION BY i.hash) THEN 'imported' ELSE 'duplicate' END WHEN b.deleted_at IS NOT NULL THEN 'duplicate_trashed' ELSE 'duplicate' END AS status,
       CASE WHEN i.id % 4 IN (1, 3) THEN i.id END AS asset_id, CASE WHEN i.id % 4 IN (1, 3) THEN a.book_id END AS book_id
FROM {import_candidates} i JOIN {assets} a ON a.id = i.id JOIN {books} b ON b.id = a.book_id""")(
    lambda c: files.dedupe_import(c.import_candidates, c.assets, c.books))
BINDINGS["group_sources"] = """
SELECT CAST(floor(book_id / 2) AS BIGINT) AS group_id, id AS source_id,
       CASE WHEN book_id % 8 IN (0, 1) THEN original_hash WHEN book_id % 8 IN (2, 3) THEN CASE WHEN book_id % 2 = 0 THEN current_hash ELSE md5('n' || CAST(id % 3 AS STRING)) END
            WHEN book_id % 8 IN (4, 5) THEN md5('n' || CAST(id % 3 AS STRING)) ELSE CASE WHEN book_id % 2 = 0 THEN original_hash ELSE md5('no') END END AS hash
FROM {assets}
"""
query("resolve_group", """
WITH o AS (SELECT group_id, hash, count(*) AS copies FROM {group_sources} GROUP BY group_id, hash),
k AS (SELECT hash, min(book_id) AS book_id FROM (SELECT original_hash AS hash, book_id FROM {assets} UNION SELECT current_hash, book_id FROM {assets}) u GROUP BY hash),
g AS (SELECT o.group_id, count(*) FILTER (k.book_id IS NULL) AS new_files, CAST(sum(o.copies - 1) AS BIGINT) AS repeats, min(k.book_id) AS lo, max(k.book_id) AS hi FROM o LEFT JOIN k ON k.hash = o.hash GROUP BY o.group_id)
SELECT g.group_id, CASE WHEN lo <> hi THEN 'conflict' WHEN lo IS NULL THEN 'new_book' WHEN new_files = 0 THEN 'all_known' ELSE 'attached' END AS outcome,
       CASE WHEN lo = hi THEN lo END AS book_id, new_files, repeats, coalesce(lo = hi AND new_files > 0 AND b.deleted_at IS NOT NULL, false) AS restored
FROM g LEFT JOIN {books} b ON b.id = g.lo""")(lambda c: files.resolve_groups(c.group_sources, c.assets, c.books))


def overlay_sources(c: Catalog) -> DataFrame:
    """Sources with a full sidecar, a partial one, a telling file name, or nothing."""
    return c.orders.selectExpr(
        "o_orderkey AS id", "CAST(o_custkey AS STRING) AS k", "o_orderkey % 4 AS kind").selectExpr(
        "id", "CASE WHEN kind = 2 THEN concat('d/File ', k, ' -- Eve Day -- X -- 1999.epub') ELSE concat('d/plain ', k, '.fb2.zip') END AS filename",
        "CASE WHEN kind IN (0, 1) THEN concat('Inner ', k) ELSE '' END AS e_title", "CASE WHEN kind = 1 THEN 'inner sort' ELSE '' END AS e_sort_title",
        "CASE WHEN kind IN (0, 1) THEN array('Ann Lee') ELSE array() END AS e_authors", "CASE WHEN kind IN (0, 1) THEN 'isbn:1' ELSE '' END AS e_identifier",
        "CASE WHEN kind = 1 THEN array('x') END AS e_tags",
        "CASE WHEN kind = 0 THEN concat('Side ', k) ELSE '' END AS s_title", "'' AS s_sort_title", "CASE WHEN kind = 0 THEN array('Bo Roy', 'Cher') ELSE array() END AS s_authors",
        "CASE WHEN kind = 1 THEN 'isbn:2' ELSE '' END AS s_identifier", "CASE WHEN kind = 1 THEN CAST(array() AS array<string>) END AS s_tags")


query("resolve_source_metadata", """
SELECT id, CASE kind WHEN 0 THEN 'Side ' || k WHEN 1 THEN 'Inner ' || k WHEN 2 THEN 'File ' || k ELSE 'plain ' || k END AS title,
       CASE kind WHEN 0 THEN 'Side ' || k WHEN 1 THEN 'inner sort' WHEN 2 THEN 'File ' || k ELSE 'plain ' || k END AS sort_title,
       CASE kind WHEN 0 THEN 'Bo Roy|Cher' WHEN 1 THEN 'Ann Lee' WHEN 2 THEN 'Eve Day' ELSE '' END AS authors,
       CASE kind WHEN 0 THEN 'Roy, Bo|Cher' WHEN 1 THEN 'Lee, Ann' WHEN 2 THEN 'Day, Eve' ELSE '' END AS author_sorts,
       CASE kind WHEN 1 THEN 'isbn:2' ELSE '' END AS identifier, CASE WHEN kind = 1 THEN CAST(0 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS n_tags
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS k, o_orderkey % 4 AS kind FROM {orders}) x""")(
    lambda c: files.resolve_source_metadata(overlay_sources(c)).select(
        "id", "title", "sort_title", F.array_join("authors", "|").alias("authors"), F.array_join("author_sorts", "|").alias("author_sorts"), "identifier",
        F.coalesce(F.size("tags"), F.lit(-1)).cast("long").alias("n_tags")))
query("resolve_added_at", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(epoch(o_orderdate) AS BIGINT) WHEN 1 THEN 1500000000 ELSE CASE WHEN o_orderkey % 4 = 2 THEN 1400000000 ELSE 1700000000 END END AS added_at FROM {orders}""")(
    lambda c: c.orders.select(F.col("o_orderkey").alias("id"), files.resolve_added_at(
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN 'oops' WHEN 2 THEN '2090-01-01T00:00:00+00:00' ELSE '' END"),
        F.expr("CASE o_orderkey % 4 WHEN 1 THEN array(1600000000L, 1500000000L, -5L) WHEN 2 THEN array(1400000000L, 1900000000L) ELSE array(0L, 1900000000L) END"),
        F.lit(1700000000).cast("long")).alias("added_at")))
# Scans of an incoming folder: paths come and go, fingerprints change now and then.
BINDINGS["folder_scans"] = """
SELECT CAST(floor(event_id / 20) AS BIGINT) AS scan, 'f' || CAST(user_id AS STRING) AS path, max(CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) < 50 THEN 'a' ELSE 'b' END) AS fingerprint
FROM {events} GROUP BY CAST(floor(event_id / 20) AS BIGINT), user_id
"""
GATE = """
WITH s AS (SELECT *, CASE WHEN lag(scan) OVER w = scan - 1 AND lag(fingerprint) OVER w = fingerprint THEN 0 ELSE 1 END AS starts FROM {folder_scans} WINDOW w AS (PARTITION BY path ORDER BY scan)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY scan) AS run FROM s)
SELECT path, fingerprint, CAST(min(scan) + 1 AS BIGINT) AS released_at FROM r GROUP BY path, run, fingerprint HAVING count(*) >= 2"""
query("stability_gate", GATE)(lambda c: files.stability_gate(c.folder_scans, 2))


def gate_on_a_stream(c: Catalog) -> DataFrame:
    """The same releases from a stream that stops after half of the scans and is started again from its checkpoint."""
    spark, scans = c.spark, c.folder_scans.select("scan", "path", "fingerprint")
    place = f"{ensure_checkpoint_dir(spark)}/watch-{uuid.uuid4().hex}"
    half = scans.agg(F.floor(F.max("scan") / 2).alias("half")).scalar()
    for part, rows in (("first", scans.where(F.col("scan") <= half)), ("second", scans.where(F.col("scan") > half))):
        rows.write.parquet(f"{place}/in/{part}")
        stream = spark.readStream.schema(jobs.SIGHTINGS).parquet(f"{place}/in/*")
        jobs.release(stream, 2, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.schema(jobs.RELEASES).parquet(f"{place}/out")


query("watch_folder", GATE)(gate_on_a_stream)

# --- exports ---------------------------------------------------------------------------
BINDINGS["notes"] = """
SELECT id, user_id, asset_id, book_id, quote, deleted, created_at, created_at + CASE WHEN id % 2 = 0 THEN 60 ELSE 0 END AS updated_at,
       CASE WHEN id % 3 = 0 THEN 'Note_' || CAST(id AS STRING) ELSE '' END AS note, 'blue' AS color, CAST(1 AS BIGINT) AS revision, '' AS context_before, '' AS context_after,
       CASE WHEN id % 4 = 0 THEN id % 90 + 1 ELSE CAST(0 AS BIGINT) END AS page FROM {annotations}
"""
query("export_annotations_jsonld", """
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY asset_id, created_at, id) - 1 AS BIGINT) AS place, count(*) OVER (PARTITION BY book_id) AS total,
       'urn:lib:annotation:' || CAST(id AS VARCHAR) AS uri, CASE WHEN page > 0 THEN 'page=' || CAST(page AS VARCHAR) END AS fragment, md5(quote) AS exact, CASE WHEN note <> '' THEN note END AS body,
       strftime(make_timestamp(updated_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM {notes} WHERE deleted = 0""")(
    lambda c: exports.export_annotations_jsonld(c.notes, "lib").select(
        "book_id", "place", "total", F.get_json_object("item", "$.id").alias("uri"), F.get_json_object("item", "$.target.selector.value").alias("fragment"),
        F.md5(F.coalesce(F.get_json_object("item", "$.target.selector.exact"), F.get_json_object("item", "$.target.selector.refinedBy.exact"))).alias("exact"),
        F.get_json_object("item", "$.body.value").alias("body"), F.get_json_object("item", "$.modified").alias("modified")))
query("export_collection_head", """
SELECT book_id, '{{"@context":"http://www.w3.org/ns/anno.jsonld","id":"urn:lib:annotations:' || CAST(book_id AS VARCHAR) || '","type":"AnnotationCollection","total":' || CAST(n AS VARCHAR)
       || CASE WHEN n > 0 THEN ',"first":{{"id":"urn:lib:annotations:' || CAST(book_id AS VARCHAR) || ':page:1","type":"AnnotationPage","startIndex":0}}}}' ELSE '}}' END AS head
FROM (SELECT book_id, count(*) FILTER (deleted = 0) AS n FROM {notes} GROUP BY book_id) x""")(lambda c: exports.collection_head(c.notes, "lib"))
ESC = r"replace(replace(regexp_replace({}, '([\\`*_\[\]])', '\\\1', 'g'), '<', '&lt;'), '>', '&gt;')"
query("export_annotations_markdown", rf"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY asset_id, created_at, id) - 1 AS place FROM {{notes}} WHERE deleted = 0)
SELECT book_id, CAST(place AS BIGINT) AS place, md5(chr(10) || '## Highlight ' || CAST(place + 1 AS VARCHAR) || chr(10) || chr(10)
  || array_to_string(list_transform(string_split({ESC.format('quote')}, chr(10)), lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), chr(10)) || chr(10)
  || CASE WHEN note <> '' THEN chr(10) || '### Note' || chr(10) || chr(10) || {ESC.format('note')} || chr(10) ELSE '' END
  || chr(10) || 'Highlighted ' || strftime(make_timestamp(created_at * 1000000), '%-d %b %Y, %H:%M UTC') || CASE WHEN updated_at > created_at THEN ' · Updated ' || strftime(make_timestamp(updated_at * 1000000), '%-d %b %Y, %H:%M UTC') ELSE '' END
  || chr(10) || chr(10) || 'Color: blue' || chr(10)) AS block FROM n
UNION ALL
SELECT x.book_id, CAST(-1 AS BIGINT), md5('# ' || coalesce(b.title, 'Untitled') || chr(10) || chr(10) || CASE n WHEN 0 THEN 'No highlights' WHEN 1 THEN '1 highlight' ELSE CAST(n AS VARCHAR) || ' highlights' END || chr(10)
  || CASE WHEN n = 0 THEN chr(10) || '_No highlights or notes for this book._' || chr(10) ELSE '' END)
FROM (SELECT book_id, count(*) FILTER (deleted = 0) AS n FROM {{notes}} GROUP BY book_id) x LEFT JOIN {{books}} b ON b.id = x.book_id""")(
    lambda c: exports.export_annotations_markdown(c.notes, c.books).select("book_id", "place", F.md5("block").alias("block")))

# --- model audit -----------------------------------------------------------------------
# A log of status changes in which some rows break the model.
BINDINGS["reading_events"] = """
SELECT o_orderkey AS id, o_custkey + 1 AS user_id,
       CASE WHEN o_orderkey % 31 = 0 THEN 'lost' WHEN o_orderkey % 3 = 0 THEN 'unread' WHEN o_orderkey % 3 = 1 THEN 'reading' ELSE 'dropped' END AS from_status,
       CASE WHEN o_orderkey % 29 = 0 THEN 'done' WHEN o_orderkey % 4 = 0 THEN 'reading' ELSE 'finished' END AS to_status,
       CASE o_orderkey % 11 WHEN 0 THEN 'import' WHEN 1 THEN 'kosync' WHEN 2 THEN 'opds' WHEN 3 THEN 'kobo' WHEN 4 THEN 'web_reader' ELSE 'manual' END AS source
FROM {orders}
"""
_RULES = {"is_primary": "one primary per book", "is_default": "one default per user"}
_MORE = [f"UNION ALL SELECT '{t}', '{_RULES.get(only, 'unique ' + ', '.join(keys))}', count(*) FROM (SELECT {keys[0]} FROM {{{t}}} {'WHERE ' + only if only else ''} GROUP BY {', '.join(keys)} HAVING count(*) > 1) q\n"
         for t, keys, only in audit.UNIQUE]
_MORE += [f"UNION ALL SELECT '{t}', '{column} in {target}', count(*) FROM {{{t}}} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {{{target}}})\n"
          for t, column, target in audit.FOREIGN]
def audited(c: Catalog) -> DataFrame:
    """The counts, a row for each clause, made at once: a row becomes many entries, so its partitions have to be small."""
    with fine_shuffles(c.spark):
        return cut_lineage(audit.audit_constraints(c))


query("audit_constraints", """
SELECT * FROM (
SELECT 'assets' AS tbl, 'page_count > 0' AS rule, count(*) FILTER (page_count <= 0) AS violations FROM {assets}
UNION ALL SELECT 'assets', 'hash is 32 hex digits', count(*) FILTER (NOT regexp_matches(original_hash, '^[0-9a-f]{{32}}$') OR NOT regexp_matches(current_hash, '^[0-9a-f]{{32}}$')) FROM {assets}
UNION ALL SELECT 'tags', 'kind is known', count(*) FILTER (kind NOT IN ('tag', 'genre')) FROM {tags}
UNION ALL SELECT 'users', 'role is known', count(*) FILTER (role NOT IN ('admin', 'member', 'reader')) FROM {users}
UNION ALL SELECT 'users', 'scope is known', count(*) FILTER (content_scope NOT IN ('all', 'shelves')) FROM {users}
UNION ALL SELECT 'shelves', 'query only on query shelves', count(*) FILTER (NOT ((kind = 'manual' AND query IS NULL AND query_match IS NULL) OR (kind = 'query' AND query IS NOT NULL AND query_match IS NOT NULL))) FROM {shelves}
UNION ALL SELECT 'reading_positions', 'progress within 0..1', count(*) FILTER (progress < 0 OR progress > 1) FROM {reading_positions}
UNION ALL SELECT 'reading_state', 'status is known', count(*) FILTER (status NOT IN ('unread', 'reading', 'finished', 'dropped')) FROM {reading_state}
UNION ALL SELECT 'shelves', 'kind is known', count(*) FILTER (kind NOT IN ('manual', 'query')) FROM {shelves}
UNION ALL SELECT 'shelves', 'visibility is known', count(*) FILTER (visibility NOT IN ('personal', 'shared')) FROM {shelves}
UNION ALL SELECT 'reading_positions', 'revision not negative', count(*) FILTER (revision < 0) FROM {reading_positions}
UNION ALL SELECT 'reading_events', 'old status is known', count(*) FILTER (from_status NOT IN ('unread', 'reading', 'finished', 'dropped')) FROM {reading_events}
UNION ALL SELECT 'reading_events', 'new status is known', count(*) FILTER (to_status NOT IN ('unread', 'reading', 'finished', 'dropped')) FROM {reading_events}
UNION ALL SELECT 'reading_events', 'source is known', count(*) FILTER (source NOT IN ('manual', 'web_reader', 'kosync', 'opds', 'kobo')) FROM {reading_events}
UNION ALL SELECT 'reading_events', 'status changes', count(*) FILTER (from_status = to_status) FROM {reading_events}
UNION ALL SELECT 'annotations', 'revision is positive', count(*) FILTER (revision <= 0) FROM {annotations}
UNION ALL SELECT 'annotations', 'color is known', count(*) FILTER (color NOT IN ('yellow', 'green', 'blue', 'pink', 'purple')) FROM {annotations}
UNION ALL SELECT 'feed_items', 'fingerprint is 32 hex digits', count(*) FILTER (NOT regexp_matches(fingerprint, '^[0-9a-f]{{32}}$')) FROM {feed_items}
UNION ALL SELECT 'feed_items', 'revision is positive', count(*) FILTER (revision <= 0) FROM {feed_items}
UNION ALL SELECT 'feed_items', 'first revision is positive', count(*) FILTER (first_revision <= 0) FROM {feed_items}
UNION ALL SELECT 'delivery_devices', 'preset is known', count(*) FILTER (preset NOT IN ('kindle', 'pocketbook', 'generic')) FROM {delivery_devices}
UNION ALL SELECT 'delivery_jobs', 'status is known', count(*) FILTER (status NOT IN ('queued', 'converting', 'sending', 'sent', 'failed')) FROM {delivery_jobs}
"""+"".join(_MORE)+""") r""")(audited)

# --- provider candidates -----------------------------------------------------------------
BINDINGS["catalog_rows"] = """
SELECT p_partkey % (SELECT greatest(400, CAST(floor(count(*) / 5) AS BIGINT)) FROM {part}) AS query_id, p_partkey AS idx, p_name, p_size,
       '{{"key":"/works/OL' || CAST(p_partkey AS STRING) || 'W","title":"' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END || '","author_name":["Ann Moreau"," ann moreau ","B' || CAST(p_size AS STRING)
       || '"],"publisher":[""," House ' || CAST(p_size AS STRING) || '"],"isbn":["123","0-306-40615-2","9780306406157"],"language":["eng"],"subject":["a","A","b","c","d","e","f","g","h","i"],"first_publish_year":'
       || CAST(CASE WHEN p_partkey % 2 = 0 THEN 1900 + p_size ELSE 0 END AS STRING) || ',"publish_year":[' || CAST(1950 + p_size AS STRING) || '],"cover_i":' || CAST(p_partkey % 3 AS STRING) || '}}' AS json
FROM {part}
"""
CATALOG_SQL = """
SELECT query_id, idx, 'openlibrary' AS provider, '/works/OL' || CAST(idx AS VARCHAR) || 'W' AS provider_id, p_name AS title, 'Ann Moreau|B' || CAST(p_size AS VARCHAR) AS authors, 'House ' || CAST(p_size AS VARCHAR) AS publisher,
       CAST(CASE WHEN idx % 2 = 0 THEN 1900 + p_size ELSE 1950 + p_size END AS VARCHAR) AS date, 'eng' AS language, 'isbn:0306406152' AS identifier, 'a|b|c|d|e|f|g|h|i' AS genres, idx % 3 > 0 AS has_cover
FROM {catalog_rows} WHERE idx % 11 <> 0"""
ORACLE_ONLY["catalog_candidates"] = CATALOG_SQL


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("authors", F.array_join("authors", "|")).withColumn("genres", F.array_join("genres", "|"))


query("normalize_candidates", CATALOG_SQL)(lambda c: flat(matching.normalize_catalog_rows(c.catalog_rows.select("query_id", "idx", "json"))))
BINDINGS["volume_rows"] = """
SELECT p_partkey % (SELECT greatest(400, CAST(floor(count(*) / 5) AS BIGINT)) FROM {part}) AS query_id, p_partkey AS idx, p_name, p_size,
       '{{"id":"g' || CAST(p_partkey AS STRING) || '","volumeInfo":{{"title":"' || p_name || '","subtitle":"' || CASE WHEN p_partkey % 3 = 0 THEN 'more' WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END
       || '","authors":["Ann Moreau"],"publishedDate":"' || CAST(1950 + p_size AS STRING) || '-03","industryIdentifiers":[{{"type":"OTHER","identifier":"x"}},{{"type":"isbn_13","identifier":"978-0306406157"}}],"imageLinks":{{"'
       || CASE WHEN p_partkey % 2 = 0 THEN 'thumbnail' ELSE 'unknown' END || '":"http://i/1"}}}}}}' AS json
FROM {part}
"""
query("normalize_candidates_volumes", """
SELECT query_id, idx, 'google' AS provider, 'g' || CAST(idx AS VARCHAR) AS provider_id, p_name || CASE WHEN idx % 3 = 0 THEN ': more' ELSE '' END AS title, 'Ann Moreau' AS authors, '' AS publisher,
       CAST(1950 + p_size AS VARCHAR) || '-03' AS date, '' AS language, 'isbn:9780306406157, google:g' || CAST(idx AS VARCHAR) AS identifier, '' AS genres, idx % 2 = 0 AS has_cover FROM {volume_rows}""")(
    lambda c: flat(matching.normalize_volume_rows(c.volume_rows.select("query_id", "idx", "json"))))
BINDINGS["candidate_queries"] = """
SELECT id - 1 AS query_id, CASE WHEN id % 2 = 0 THEN '0 306-40615-2' ELSE '' END AS isbn, CASE WHEN id % 3 = 0 THEN upper(title) || ' II' ELSE title END AS title,
       CASE WHEN id % 5 = 0 THEN 'moreau' ELSE 'nobody' END AS author FROM {books}
"""
query("score_candidates", """
WITH s AS (SELECT c.query_id, c.idx, CAST(CASE WHEN q.isbn <> '' THEN 70 ELSE 0 END + CASE WHEN contains(lower(c.title), lower(q.title)) OR contains(lower(q.title), lower(c.title)) THEN 18 ELSE 0 END
             + CASE WHEN q.author = 'moreau' THEN 12 ELSE 0 END + CASE WHEN c.has_cover THEN 3 ELSE 0 END AS BIGINT) AS score
           FROM {catalog_candidates} c JOIN {candidate_queries} q ON q.query_id = c.query_id)
SELECT query_id, idx, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS BIGINT) AS rn, score FROM s""")(
    lambda c: matching.score_candidates(c.candidate_queries, matching.normalize_catalog_rows(c.catalog_rows.select("query_id", "idx", "json"))))

# --- delivery ------------------------------------------------------------------------------
BINDINGS["delivery_requests"] = """
SELECT d.id AS request_id, d.id % (SELECT CAST(floor(count(*) * 1.05) AS BIGINT) FROM {part}) + 1 AS book_id, d.preset FROM {delivery_devices} d
"""
# Sizes are stretched so that the attachment limit matters.
BINDINGS["sized_assets"] = """
SELECT id, book_id, format, is_primary, original_size * 6 AS original_size, CAST(NULL AS BIGINT) AS current_size FROM {assets}
"""
query("plan_delivery", """
WITH r AS (SELECT q.request_id, q.preset, a.id, a.format, a.is_primary, a.original_size AS s, ((a.original_size + 2) // 3) * 4 AS e FROM {delivery_requests} q LEFT JOIN {sized_assets} a ON a.book_id = q.book_id),
z AS (SELECT *, s > 0 AND e + ((e + 75) // 76) * 2 + 4096 > 25 * 1048576 AS big FROM r),
k AS (SELECT *, CASE WHEN NOT big THEN CASE preset WHEN 'kindle' THEN CASE format WHEN 'epub' THEN 1 WHEN 'pdf' THEN 3 WHEN 'txt' THEN 4 END WHEN 'pocketbook' THEN CASE format WHEN 'epub' THEN 1 WHEN 'fb2' THEN 2 WHEN 'pdf' THEN 3 WHEN 'mobi' THEN 4 WHEN 'txt' THEN 5 END END END AS d,
             CASE preset WHEN 'kindle' THEN CASE format WHEN 'fb2' THEN 2 WHEN 'mobi' THEN 2 WHEN 'txt' THEN 9 END WHEN 'pocketbook' THEN CASE WHEN format IN ('txt', 'mobi') THEN 9 END END AS v,
             big AND CASE preset WHEN 'kindle' THEN format IN ('epub', 'pdf', 'txt') WHEN 'pocketbook' THEN format IN ('epub', 'fb2', 'pdf', 'mobi', 'txt') ELSE false END AS over FROM z),
b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY least(coalesce(d, 99), coalesce(v, 99)), NOT is_primary, id) AS n, bool_or(over) OVER (PARTITION BY request_id) AS any_over FROM k)
SELECT request_id, CASE WHEN ok THEN id END AS asset_id, CASE WHEN ok THEN format END AS format, CASE WHEN ok THEN CASE WHEN coalesce(d, 99) <= coalesce(v, 99) THEN '' ELSE 'epub' END END AS target,
       CASE WHEN ok THEN '' WHEN coalesce(any_over, false) THEN 'too_large' ELSE 'no_compatible_format' END AS reason
FROM (SELECT *, least(coalesce(d, 99), coalesce(v, 99)) < 99 AS ok FROM b WHERE n = 1) x""".replace("AS over FROM", "AS oversize FROM").replace("bool_or(over)", "bool_or(oversize)"))(
    lambda c: matching.plan_delivery(c.delivery_requests, c.sized_assets))
query("preset_from_email", """
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'kindle' WHEN 1 THEN 'kindle' WHEN 2 THEN 'pocketbook' ELSE 'generic' END AS preset FROM (SELECT id AS user_id FROM {users}) u""")(
    lambda c: c.users.select(F.col("id").alias("user_id"), matching.preset_from_email(F.expr(
        "concat(' ', username, CASE id % 4 WHEN 0 THEN '@Kindle.com' WHEN 1 THEN '@free.kindle.cn ' WHEN 2 THEN '@PBSYNC.com' ELSE '@example.org' END)")).alias("preset")))
