"""Catalogue edits, layout plans and integrity checks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import browse, edit
from foliant.plans.bindings import BINDINGS, ORACLE_ONLY
from foliant.plans.q_dedupe import PRIORITY
from foliant.plans.q_normalize import PATH_SQL, TEMPLATE, path_columns
from foliant.plans.registry import query
from foliant.sources.catalog import Catalog

BINDINGS["author_edits"] = """
SELECT l_partkey + 1 AS book_id, (l_orderkey * 10 + l_linenumber) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000 AS idx,
       CASE WHEN l_suppkey % 3 = 0 THEN 'New ' || CAST(l_suppkey AS STRING) ELSE a.name END AS name,
       'Sort ' || CAST(l_orderkey AS STRING) AS sort_name
FROM {lineitem} l JOIN {authors} a ON a.id = l.l_suppkey + 1
"""
ORACLE_ONLY["upserted"] = """
WITH once AS (SELECT book_id, name, min(idx) AS idx, min_by(sort_name, idx) AS sort_name FROM {author_edits} GROUP BY book_id, name),
fresh AS (SELECT name, min_by(sort_name, row(book_id, idx)) AS new_sort FROM once WHERE name NOT IN (SELECT name FROM {authors}) GROUP BY name),
numbered AS (SELECT *, row_number() OVER (ORDER BY name) + (SELECT max(id) FROM {authors}) AS new_id FROM fresh)
SELECT o.book_id, coalesce(a.id, n.new_id) AS author_id, o.name, coalesce(a.sort_name, n.new_sort) AS sort_name,
       row_number() OVER (PARTITION BY o.book_id ORDER BY o.idx) - 1 AS author_order
FROM once o LEFT JOIN {authors} a ON a.name = o.name LEFT JOIN numbered n ON n.name = o.name"""
query("upsert_book_authors", "SELECT book_id, CAST(author_id AS BIGINT) AS author_id, name, sort_name, CAST(author_order AS BIGINT) AS author_order FROM {upserted}")(
    lambda c: edit.upsert_book_authors(c.author_edits, c.authors))
query("primary_author_sort", "SELECT book_id, sort_name AS primary_author_sort FROM {upserted} WHERE author_order = 0")(
    lambda c: edit.primary_sort(edit.upsert_book_authors(c.author_edits, c.authors)))

# Every seventh author is renamed, every fifth of those onto an existing name.
BINDINGS["author_renames"] = """
SELECT a.name AS old_name, CASE WHEN a.id % 35 = 0 THEN b.name ELSE 'Renamed ' || CAST(a.id AS STRING) END AS new_name, 'R' || CAST(a.id AS STRING) AS new_sort
FROM {authors} a JOIN {authors} b ON b.id = CASE WHEN a.id > 1 THEN a.id - 1 ELSE a.id END WHERE a.id % 7 = 0
"""
query("rename_authors", """
SELECT a.id, coalesce(r.new_name, a.name) AS name, coalesce(r.new_sort, a.sort_name) AS sort_name
FROM {authors} a LEFT JOIN {author_renames} r ON r.old_name = a.name WHERE r.new_name IS NULL OR r.new_name NOT IN (SELECT name FROM {authors})""")(
    lambda c: edit.rename_authors(c.author_renames, c.authors, c.book_authors)[0])
query("rename_author_links", """
WITH m AS (SELECT a.id AS author_id, t.id AS target_id FROM {author_renames} r JOIN {authors} a ON a.name = r.old_name JOIN {authors} t ON t.name = r.new_name)
SELECT book_id, author_id, author_order FROM (
  SELECT l.book_id, coalesce(m.target_id, l.author_id) AS author_id, l.author_order,
         row_number() OVER (PARTITION BY l.book_id, coalesce(m.target_id, l.author_id) ORDER BY m.target_id IS NOT NULL, l.author_order) AS n
  FROM {book_authors} l LEFT JOIN m ON m.author_id = l.author_id) q WHERE n = 1""")(
    lambda c: edit.rename_authors(c.author_renames, c.authors, c.book_authors)[1])
query("set_author_sort", "SELECT DISTINCT book_id FROM {book_authors} WHERE author_id = 16")(
    lambda c: edit.set_author_sort(c.authors, c.book_authors, "Dmitri Moreau 15", "Moreau, D."))
# Customers stand for people who have no book.
BINDINGS["people"] = """
SELECT id, name, sort_name FROM {authors} UNION ALL SELECT c_custkey + 1000000000000, c_name, c_name FROM {customer}
"""
query("orphan_authors", "SELECT id, name, sort_name FROM {people} WHERE id NOT IN (SELECT author_id FROM {book_authors})")(
    lambda c: edit.orphan_authors(c.people, c.book_authors))
query("orphan_tags", """
SELECT id, name FROM {tags} t WHERE NOT EXISTS (SELECT 1 FROM {tags} d JOIN {book_tags} x ON x.tag_id = d.id
  WHERE d.kind = t.kind AND (d.id = t.id OR starts_with(d.name_key, t.name_key || '.')))""")(
    lambda c: edit.orphan_tags(c.tags, c.book_tags).select("id", "name"))

BINDINGS["tag_edits"] = """
SELECT book_id, idx, name FROM (
  SELECT p_partkey + 1 AS book_id, CAST(0 AS BIGINT) AS idx, 'shelf.' || lower(p_type) || '.Fresh ' || CAST(p_size AS STRING) AS name FROM {part} WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey + 1, CAST(1 AS BIGINT), 'Own' || CAST(p_partkey % 7 AS STRING) || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'Deep' ELSE 'DEEP' END FROM {part} WHERE p_partkey % 3 = 0
) e
"""
query("set_book_tags_nodes", """
SELECT DISTINCT 'tag' AS kind, lower(name) AS name_key, 'Shelf.' || upper(split_part(name, '.', 2)) || '.' || split_part(name, '.', 3) AS name FROM {tag_edits} WHERE idx = 0
UNION ALL SELECT DISTINCT 'tag', lower(split_part(name, '.', 1)), split_part(name, '.', 1) FROM {tag_edits} WHERE idx = 1
UNION ALL SELECT 'tag', lower(name), min_by(name, book_id) FROM {tag_edits} WHERE idx = 1 GROUP BY lower(name)""")(
    lambda c: edit.set_book_tags(c.tag_edits, "tag", c.tags, c.book_tags)[0])
query("set_book_tags_links", """
SELECT x.book_id, t.kind, t.name_key, x.position FROM {book_tags} x JOIN {tags} t ON t.id = x.tag_id
WHERE t.kind = 'genre' OR x.book_id NOT IN (SELECT book_id FROM {tag_edits})
UNION ALL SELECT book_id, 'tag', lower(name), idx FROM {tag_edits}""")(
    lambda c: edit.set_book_tags(c.tag_edits, "tag", c.tags, c.book_tags)[1])

# Shelf.SMALL moves onto Shelf.LARGE: shared sizes merge, the others move.
ORACLE_ONLY["renamed_links"] = """
SELECT x.book_id, t.kind, CASE WHEN t.kind = 'tag' AND (t.name_key = 'shelf.small' OR starts_with(t.name_key, 'shelf.small.')) THEN 'shelf.large' || substr(t.name_key, 12) ELSE t.name_key END AS name_key,
       min(x.position) AS position
FROM {book_tags} x JOIN {tags} t ON t.id = x.tag_id GROUP BY ALL"""
ORACLE_ONLY["renamed_links"] = ORACLE_ONLY["renamed_links"].replace("GROUP BY ALL", "GROUP BY x.book_id, t.kind, 3")
query("rename_tag_links", "SELECT book_id, kind, name_key, position FROM {renamed_links}")(
    lambda c: edit.rename_tag(c.tags, c.book_tags, 3005, " shelf . Large")[1])
query("rename_tag_nodes", """
WITH n AS (SELECT kind, CASE WHEN kind = 'tag' AND (name_key = 'shelf.small' OR starts_with(name_key, 'shelf.small.')) THEN 'Shelf.LARGE' || substr(name, 12) ELSE name END AS name FROM {tags})
SELECT DISTINCT n.kind, lower(n.name) AS name_key, n.name FROM n WHERE EXISTS (
  SELECT 1 FROM {renamed_links} l WHERE l.kind = n.kind AND (l.name_key = lower(n.name) OR starts_with(l.name_key, lower(n.name) || '.')))""")(
    lambda c: edit.rename_tag(c.tags, c.book_tags, 3005, " shelf . Large")[0])
query("delete_tag", """
WITH gone AS (SELECT id FROM {tags} WHERE kind = 'tag' AND (name_key = 'shelf.promo' OR starts_with(name_key, 'shelf.promo.'))),
l AS (SELECT * FROM {book_tags} WHERE tag_id NOT IN (SELECT id FROM gone))
SELECT t.id, t.name FROM {tags} t WHERE t.id NOT IN (SELECT id FROM gone) AND EXISTS (
  SELECT 1 FROM {tags} d JOIN l ON l.tag_id = d.id WHERE d.kind = t.kind AND (d.id = t.id OR starts_with(d.name_key, t.name_key || '.')))""")(
    lambda c: edit.delete_tag(c.tags, c.book_tags, 3004)[0].select("id", "name"))

# --- bulk edit over every live book ----------------------------------------------------
BULK = edit.BulkEdit(genres=("add", ["Asia", "Fresh"]), tags=("remove", ["shelf.small"]), series="Brand#7", index_mode="assign",
                     index_start=2.0, index_step=0.5)


def bulk_rows(c: Catalog) -> DataFrame:
    """Editable state of the live books; authors stay out unless an operation needs them."""
    linked = c.book_tags.join(c.tags, F.col("tag_id") == c.tags.id)
    lists = linked.groupBy("book_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "tag_id", "name", "name_key")))).alias(kind)
        for kind in ("genre", "tag")])
    none = F.array().cast("array<string>")
    return browse.live(c.books).join(lists, F.col("id") == F.col("book_id"), "left").select(
        "id", F.coalesce("genre.name", none).alias("genres"), F.coalesce("genre.name_key", none).alias("genre_keys"),
        F.coalesce("tag.name", none).alias("tags"), F.coalesce("tag.name_key", none).alias("tag_keys"),
        none.alias("authors"), "series", "series_index", "manual_overrides")


query("bulk_edit", """
WITH t AS (SELECT x.book_id, list(t.name ORDER BY x.position, x.tag_id) FILTER (t.kind = 'genre') AS genres,
                  list(t.name ORDER BY x.position, x.tag_id) FILTER (t.kind = 'tag') AS tags
           FROM {book_tags} x JOIN {tags} t ON t.id = x.tag_id GROUP BY x.book_id),
b AS (SELECT b.id, coalesce(t.genres, []) AS genres, coalesce(t.tags, []) AS tags, b.series, b.series_index, b.manual_overrides, CAST(2.0 + 0.5 * (b.id % 100) AS DOUBLE) AS new_index
      FROM {books} b LEFT JOIN t ON t.book_id = b.id WHERE b.deleted_at IS NULL),
n AS (SELECT *, list_contains(list_transform(genres, lambda g: lower(g)), 'asia') AS has_asia,
             len(list_filter(tags, lambda g: lower(g) = 'shelf.small')) > 0 AS had_small,
             coalesce(series, '') <> 'Brand#7' AS series_changed, (CASE WHEN series_index > 0 THEN series_index END) IS DISTINCT FROM new_index AS index_changed FROM b)
SELECT id, array_to_string(list_concat(genres, CASE WHEN has_asia THEN ['Fresh'] ELSE ['Asia', 'Fresh'] END), '|') AS genres,
       array_to_string(list_filter(tags, lambda g: lower(g) <> 'shelf.small'), '|') AS tags, 'Brand#7' AS series, new_index AS series_index,
       '{{"genres":true' || CASE WHEN series_changed THEN ',"series":true' ELSE '' END || CASE WHEN index_changed THEN ',"series_index":true' ELSE '' END
         || CASE WHEN had_small THEN ',"tags":true' ELSE '' END || CASE WHEN manual_overrides IS NOT NULL THEN ',"title":true' ELSE '' END || '}}' AS overrides,
       series_changed OR index_changed AS relayout FROM n""")(
    lambda c: edit.bulk_edit(c.books.select("id", (F.col("id") % 100).alias("pos")), bulk_rows(c), BULK).select(
        "id", F.array_join("genres", "|").alias("genres"), F.array_join("tags", "|").alias("tags"), "series", "series_index", "overrides", "relayout"))

query("soft_delete", """
SELECT id, CASE WHEN id % 6 = 1 AND deleted_at IS NULL THEN 1700000000 ELSE deleted_at END AS deleted_at,
       CASE WHEN id % 6 = 1 AND deleted_at IS NULL THEN 7 ELSE deleted_by END AS deleted_by, id % 6 = 1 AND deleted_at IS NULL AS changed FROM {books}""")(
    lambda c: edit.soft_delete(c.books, c.books.where("id % 6 = 1").select("id", F.lit(7).cast("long").alias("user_id")), 1700000000))
query("restore", """
SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN id % 2 = 0 AND deleted_at IS NOT NULL THEN NULL ELSE deleted_by END AS deleted_by,
       id % 2 = 0 AND deleted_at IS NOT NULL AS changed FROM {books}""")(lambda c: edit.restore(c.books, c.books.where("id % 2 = 0").select("id")))


def purge_counts(c: Catalog) -> DataFrame:
    left = edit.purge(c.books, {"assets": c.assets, "book_authors": c.book_authors, "book_tags": c.book_tags, "shelf_books": c.shelf_books})
    parts = [df.groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("rows")) for name, df in left.items()]
    parts.append(edit.orphan_authors(c.authors, left["book_authors"]).groupBy(F.lit("orphans").alias("name")).agg(F.count(F.lit(1)).alias("rows")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_LIVE = "(SELECT id FROM {books} WHERE deleted_at IS NULL)"
query("purge", f"""
SELECT * FROM (SELECT 'books' AS name, count(*) AS rows FROM {{books}} WHERE deleted_at IS NULL
UNION ALL SELECT 'assets', count(*) FROM {{assets}} WHERE book_id IN {_LIVE}
UNION ALL SELECT 'book_authors', count(*) FROM {{book_authors}} WHERE book_id IN {_LIVE}
UNION ALL SELECT 'book_tags', count(*) FROM {{book_tags}} WHERE book_id IN {_LIVE}
UNION ALL SELECT 'shelf_books', count(*) FROM {{shelf_books}} WHERE book_id IN {_LIVE}
UNION ALL SELECT 'orphans', count(*) FROM {{authors}} WHERE id NOT IN (SELECT author_id FROM {{book_authors}} WHERE book_id IN {_LIVE})) q WHERE rows > 0""")(purge_counts)
query("preferred_primary_asset", f"""
SELECT book_id, id AS asset_id, format, NOT is_primary AS promoted FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {PRIORITY}, NOT is_primary, created_at, id) AS n FROM {{assets}}) q WHERE n = 1""")(
    lambda c: edit.choose_primary_assets(c.assets))

BINDINGS["shelf_requests"] = """
SELECT c_custkey % 130 + 1 AS shelf_id, o_orderkey AS idx, o_orderkey % (SELECT CAST(floor(count(*) * 1.05) AS BIGINT) FROM {part}) + 1 AS book_id FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""
query("shelf_add", """
WITH f AS (SELECT shelf_id, book_id, min(idx) AS idx FROM {shelf_requests} r
           WHERE NOT EXISTS (SELECT 1 FROM {shelf_books} s WHERE s.shelf_id = r.shelf_id AND s.book_id = r.book_id) GROUP BY shelf_id, book_id)
SELECT f.shelf_id, f.book_id, CAST(coalesce(e.base, 0) + row_number() OVER (PARTITION BY f.shelf_id ORDER BY f.idx) - 1 AS BIGINT) AS position
FROM f LEFT JOIN (SELECT shelf_id, max(position) + 1 AS base FROM {shelf_books} GROUP BY shelf_id) e ON e.shelf_id = f.shelf_id""")(
    lambda c: edit.shelf_add(c.shelf_books, c.shelf_requests))
query("shelf_remove", """
SELECT shelf_id, book_id, position, added_at FROM {shelf_books} s WHERE NOT EXISTS (SELECT 1 FROM {shelf_requests} r WHERE r.shelf_id = s.shelf_id AND r.book_id = s.book_id)""")(
    lambda c: edit.shelf_remove(c.shelf_books, c.shelf_requests).select("shelf_id", "book_id", "position", "added_at"))

ORACLE_ONLY["writable"] = """
SELECT a.id, a.book_id, a.format, a.updated_at, b.metadata_rev, a.writeback_rev, a.writeback_rev < b.metadata_rev AS dirty,
       a.writeback_rev < b.metadata_rev AND coalesce(a.writeback_error, '') <> '' AS failed
FROM {assets} a JOIN {books} b ON b.id = a.book_id WHERE b.deleted_at IS NULL AND a.format IN ('epub', 'fb2', 'kepub')"""
query("writeback_counts", "SELECT count(*) FILTER (dirty) AS dirty, count(*) FILTER (failed) AS failed FROM {writable}")(
    lambda c: edit.writeback_counts(c.assets, c.books))
query("writeback_book_state", "SELECT book_id, count(*) AS writable, count(*) FILTER (dirty) AS dirty FROM {writable} GROUP BY book_id")(
    lambda c: edit.writeback_book_state(c.assets, c.books))
for _mode, _cond in {"dirty": "dirty", "failed": "failed", "all": "true", "automatic": "dirty AND (NOT failed OR updated_at <= 900000000)"}.items():
    query(f"writeback_backlog_{_mode}", f"""
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS rn, id, book_id, format, metadata_rev, writeback_rev, failed FROM {{writable}} WHERE {_cond} QUALIFY rn <= 500""")(
        lambda c, m=_mode: edit.writeback_backlog(c.assets, c.books, m, 500, 900000000))
BINDINGS["byte_updates"] = """
SELECT id, CASE WHEN id % 3 = 0 THEN current_hash ELSE md5(CAST(id AS STRING)) END AS hash, original_size + 5 AS size,
       CASE WHEN id % 2 = 0 THEN id % 9 END AS metadata_rev FROM {assets} WHERE id % 4 <> 3
"""
query("record_asset_bytes", """
SELECT a.id, u.hash AS current_hash, u.size AS current_size, CASE WHEN a.current_hash = u.hash THEN a.sampled_hash END AS sampled_hash,
       CAST(coalesce(u.metadata_rev, CASE WHEN a.current_hash = u.hash THEN a.writeback_rev ELSE 0 END) AS BIGINT) AS writeback_rev
FROM {assets} a JOIN {byte_updates} u ON u.id = a.id""")(lambda c: edit.record_asset_bytes(c.assets, c.byte_updates))

query("relayout_plan", f"""
WITH r AS (SELECT asset_id, storage_path AS old_path, {PATH_SQL} AS new_path FROM {{path_rows}}),
x AS (SELECT *, count(*) OVER (PARTITION BY new_path) > 1 AS collides FROM r)
SELECT asset_id, old_path, new_path, collides FROM x WHERE new_path <> old_path OR collides""")(
    lambda c: edit.relayout_plan(c.path_rows, TEMPLATE, path_columns()))
query("relayout_collisions", """
WITH r AS (SELECT asset_id, storage_path AS old_path, title || extension AS new_path FROM {path_rows}),
x AS (SELECT *, count(*) OVER (PARTITION BY new_path) > 1 AS collides FROM r)
SELECT asset_id, old_path, new_path, collides FROM x WHERE new_path <> old_path OR collides""")(
    lambda c: edit.relayout_plan(c.path_rows, "{title}{dot_ext}", path_columns()))

# An inventory that drifted: some files gone, grown, rewritten, retyped, and some unknown.
BINDINGS["inventory"] = """
SELECT CASE WHEN id % 23 = 0 THEN storage_path || '.bak' ELSE storage_path END AS path,
       CASE WHEN id % 13 = 0 THEN original_size + 77 ELSE current_size END AS size,
       CASE WHEN id % 17 = 0 THEN md5(storage_path) ELSE current_hash END AS hash,
       CASE WHEN id % 19 = 0 THEN 'rtf' ELSE format END AS format
FROM {assets} WHERE id % 29 <> 0
"""
query("reconcile_storage", """
WITH j AS (SELECT a.id AS asset_id, coalesce(a.storage_path, f.path) AS path, a.id IS NOT NULL AS known, f.path IS NOT NULL AS found,
                  a.current_size AS cs, f.size AS fs, a.current_hash AS ch, f.hash AS fh, a.format AS af, f.format AS ff
           FROM {assets} a FULL OUTER JOIN {inventory} f ON f.path = a.storage_path)
SELECT 'missing_file' AS kind, path, asset_id FROM j WHERE known AND NOT found
UNION ALL SELECT 'orphan_file', path, asset_id FROM j WHERE NOT known
UNION ALL SELECT 'missing_size', path, asset_id FROM j WHERE known AND found AND cs IS NULL
UNION ALL SELECT 'size_mismatch', path, asset_id FROM j WHERE known AND found AND cs <> fs
UNION ALL SELECT 'hash_mismatch', path, asset_id FROM j WHERE known AND found AND cs = fs AND ch <> fh
UNION ALL SELECT 'format_mismatch', path, asset_id FROM j WHERE known AND found AND af <> ff""")(
    lambda c: edit.reconcile_storage(c.assets, c.inventory))

BINDINGS["measured_pages"] = """
SELECT id AS asset_id, CASE WHEN id % 5 = 0 THEN md5('x') ELSE current_hash END AS hash, id % 900 AS pages FROM {assets} WHERE id % 2 = 0
"""
query("page_count_backfill", """
SELECT a.id, coalesce(a.page_count, CASE WHEN m.hash = a.current_hash AND m.pages > 0 AND b.deleted_at IS NULL THEN m.pages END) AS page_count,
       a.page_count IS NULL AND coalesce(m.hash = a.current_hash AND m.pages > 0 AND b.deleted_at IS NULL, false) AS changed
FROM {assets} a LEFT JOIN {measured_pages} m ON m.asset_id = a.id JOIN {books} b ON b.id = a.book_id""")(
    lambda c: edit.page_count_backfill(c.assets, c.books, c.measured_pages))
