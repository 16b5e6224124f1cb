"""Duplicate detection and merging, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import dedupe
from foliant.plans.bindings import BINDINGS, ORACLE_ONLY
from foliant.plans.registry import query
from foliant.sources.catalog import Catalog

ORACLE_ONLY["dup_groups"] = """
SELECT plain_key AS key, count(*) AS size, max(added_at) AS newest, min(id) AS first_id FROM {duplicate_sets} GROUP BY plain_key HAVING count(*) >= 2"""

BINDINGS["dismissals"] = """
SELECT g.first_id AS dismissal_id, 'title_author' AS reason, s.plain_key AS key, s.id AS book_id
FROM {duplicate_sets} s JOIN (SELECT plain_key, min(id) AS first_id FROM {duplicate_sets} GROUP BY plain_key HAVING count(*) >= 2) g ON g.plain_key = s.plain_key
WHERE g.first_id % 3 = 0 OR (g.first_id % 3 = 1 AND s.id = g.first_id)
"""
# One merge request per group; some name a stranger or a missing survivor.
BINDINGS["merge_requests"] = """
SELECT g.first_id AS request_id, CASE WHEN g.first_id % 10 = 4 THEN g.first_id + 1000000 ELSE g.first_id END AS survivor_id, s.id AS book_id, s.id AS place
FROM {duplicate_sets} s JOIN (SELECT plain_key, min(id) AS first_id FROM {duplicate_sets} GROUP BY plain_key HAVING count(*) >= 2) g ON g.plain_key = s.plain_key
UNION ALL
SELECT min(id), min(id), CASE WHEN min(id) % 2 = 0 THEN min(id) + 1 ELSE 17 * 5 + 1 END, CAST(0 AS BIGINT)
FROM {duplicate_sets} GROUP BY plain_key HAVING count(*) >= 2 AND min(id) % 7 = 0
"""
ORACLE_ONLY["good_requests"] = """
SELECT r.request_id FROM (SELECT DISTINCT request_id, survivor_id, book_id FROM {merge_requests}) r LEFT JOIN {duplicate_sets} s ON s.id = r.book_id
GROUP BY r.request_id
HAVING count(*) >= 2 AND count(s.id) = count(*) AND count(DISTINCT s.plain_key) = 1 AND bool_or(r.survivor_id = r.book_id)"""
ORACLE_ONLY["plan"] = """
SELECT survivor_id, book_id, min(place) AS place FROM {merge_requests} WHERE request_id IN (SELECT request_id FROM {good_requests}) AND book_id <> survivor_id GROUP BY survivor_id, book_id"""


def keyed(c: Catalog) -> DataFrame:
    return dedupe.keyed_books(c.books, c.first_author)


def plan(c: Catalog) -> DataFrame:
    return dedupe.merge_plan(c.merge_requests, keyed(c))


query("duplicate_key", "SELECT id, lower(title) || '|' || lower(author) AS key FROM {duplicate_sets}")(
    lambda c: c.duplicate_sets.select("id", dedupe.duplicate_key(
        F.concat(F.lit("¡ "), F.replace("title", F.lit(" "), F.lit(" -- \t")), F.lit("!?")), F.concat(F.lit("("), "author", F.lit(" )"))).alias("key")))
query("duplicate_groups", "SELECT key, size, newest, first_id FROM {dup_groups}")(lambda c: dedupe.duplicate_groups(keyed(c)))
query("duplicate_page", """
SELECT CAST(row_number() OVER (ORDER BY newest DESC, first_id) AS BIGINT) AS rn, key, size, newest, first_id, count(*) OVER () AS total
FROM {dup_groups} QUALIFY rn <= 24""")(lambda c: dedupe.duplicate_page(dedupe.duplicate_groups(keyed(c)), 24))
query("duplicate_members", "SELECT g.key, s.id, g.size FROM {duplicate_sets} s JOIN {dup_groups} g ON g.key = s.plain_key")(
    lambda c: dedupe.group_members(keyed(c), dedupe.duplicate_groups(keyed(c))))
query("apply_dismissals", """
SELECT key, size, newest, first_id FROM {dup_groups} g WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT key, dismissal_id, count(DISTINCT book_id) AS n FROM {dismissals} GROUP BY key, dismissal_id) d WHERE d.key = g.key AND d.n = g.size)""")(
    lambda c: dedupe.apply_dismissals(keyed(c), dedupe.duplicate_groups(keyed(c)), c.dismissals))
query("validate_duplicate_set", """
SELECT DISTINCT request_id, request_id IN (SELECT request_id FROM {good_requests}) AS valid FROM {merge_requests}""")(
    lambda c: dedupe.validate_duplicate_set(c.merge_requests, keyed(c)))
query("merge_books", """
WITH gifts AS (
  SELECT p.survivor_id AS id, min_by(trim(b.description), p.place) FILTER (trim(coalesce(b.description, '')) <> '') AS text,
         min_by(b.id, p.place) FILTER (b.cover_version > 0) AS cover_from
  FROM {plan} p JOIN {books} b ON b.id = p.book_id GROUP BY p.survivor_id)
SELECT b.id, CASE WHEN trim(coalesce(b.description, '')) = '' AND g.text IS NOT NULL THEN g.text ELSE b.description END AS description,
       CASE WHEN b.cover_version <= 0 AND g.cover_from IS NOT NULL THEN b.cover_version + 1 ELSE b.cover_version END AS cover_version,
       CASE WHEN b.cover_version <= 0 THEN g.cover_from END AS cover_from, CAST(NULL AS BIGINT) AS deleted_at
FROM {books} b JOIN gifts g ON g.id = b.id
UNION ALL
SELECT id, description, cover_version, NULL, 1700000000 FROM {books} WHERE id IN (SELECT book_id FROM {plan})""")(
    lambda c: dedupe.merge_books(c.books, plan(c), 1700000000))
PRIORITY = "CASE format WHEN 'epub' THEN 0 WHEN 'kepub' THEN 1 WHEN 'fb2' THEN 2 WHEN 'mobi' THEN 4 WHEN 'pdf' THEN 9 ELSE 12 END"
query("merge_assets", f"""
WITH t AS (
  SELECT a.id, coalesce(p.survivor_id, a.book_id) AS book_id, a.format, p.survivor_id IS NULL AND a.is_primary AS is_primary, a.created_at,
         CASE WHEN p.survivor_id IS NULL THEN a.writeback_rev ELSE 0 END AS writeback_rev
  FROM {{assets}} a LEFT JOIN {{plan}} p ON p.book_id = a.book_id
  WHERE p.survivor_id IS NOT NULL OR a.book_id IN (SELECT survivor_id FROM {{plan}}))
SELECT id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY {PRIORITY}, NOT is_primary, created_at, id) = 1 AS is_primary,
       CAST(writeback_rev AS BIGINT) AS writeback_rev FROM t""")(lambda c: dedupe.merge_assets(c.assets, plan(c)))
query("merge_shelves", """
SELECT shelf_id, book_id, position, added_at FROM (
  SELECT s.shelf_id, coalesce(p.survivor_id, s.book_id) AS book_id, s.position, s.added_at,
         row_number() OVER (PARTITION BY s.shelf_id, coalesce(p.survivor_id, s.book_id) ORDER BY p.survivor_id IS NOT NULL, s.book_id) AS n
  FROM {shelf_books} s LEFT JOIN {plan} p ON p.book_id = s.book_id) q WHERE n = 1""")(
    lambda c: dedupe.merge_shelves(c.shelf_books, plan(c)))
query("merge_reading_state", """
SELECT user_id, survivor_id AS book_id, status, last_event_id, updated_at FROM (
  SELECT s.*, m.survivor_id, row_number() OVER (PARTITION BY s.user_id, m.survivor_id
           ORDER BY s.updated_at DESC, s.book_id = m.survivor_id DESC, s.book_id) AS n
  FROM {reading_state} s JOIN (SELECT survivor_id, book_id FROM {plan} UNION SELECT survivor_id, survivor_id FROM {plan}) m ON m.book_id = s.book_id) q
WHERE n = 1""")(lambda c: dedupe.merge_reading_state(c.reading_state, plan(c)))
