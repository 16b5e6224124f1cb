"""Browse queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import browse
from foliant.plans.registry import query

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low(column: str) -> str:
    return LOW.replace("{}", column)


VOLUME = (
    "CASE WHEN series_index IS NOT NULL AND series_index > 0 THEN 0 ELSE 1 END, "
    "CASE WHEN series_index IS NOT NULL AND series_index > 0 THEN series_index ELSE 0 END, " + low("title")
)
ORDERS = {
    "added": "added_at DESC, id",
    "title": f"{low('sort_title')}, {low('title')}, id",
    "author": f"primary_author_sort, {low('sort_title')}, {low('title')}, id",
    "year": "published_date DESC NULLS LAST, added_at DESC, id",
    "series": f"CASE WHEN series IS NULL OR trim(series) = '' THEN 1 ELSE 0 END, {low('series')} NULLS FIRST, {VOLUME}, id",
}
SUMMARY = "id, title, series, series_index, cover_version, published_date"
PUBLICATION = "id, title, description, publisher, published_date, language, identifiers, cover_version, updated_at"

for _sort in ORDERS:
    query(f"list_books_{_sort}", f"""
SELECT CAST(rn AS BIGINT) AS rn, {SUMMARY} FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDERS[_sort]}) AS rn FROM {{books}} WHERE deleted_at IS NULL) q
WHERE rn > 25 AND rn <= 225""")(lambda c, s=_sort: browse.list_books(c.books, s, 200, 25))

query("list_manual_shelf", f"""
SELECT CAST(rn AS BIGINT) AS rn, {SUMMARY} FROM (
  SELECT b.*, row_number() OVER (ORDER BY s.position, s.added_at DESC, b.added_at DESC, b.id) AS rn
  FROM {{books}} b JOIN {{shelf_books}} s ON s.book_id = b.id WHERE s.shelf_id = 12 AND b.deleted_at IS NULL) q
WHERE rn <= 100""")(lambda c: browse.list_manual_shelf(c.books, c.shelf_books, 12, "position", 100))

query("list_manual_shelf_series", f"""
SELECT CAST(rn AS BIGINT) AS rn, {SUMMARY} FROM (
  SELECT b.*, row_number() OVER (ORDER BY {ORDERS['series']}) AS rn
  FROM (SELECT b.* FROM {{books}} b JOIN {{shelf_books}} s ON s.book_id = b.id
        WHERE s.shelf_id = 12 AND b.deleted_at IS NULL) b) q
WHERE rn <= 100""")(lambda c: browse.list_manual_shelf(c.books, c.shelf_books, 12, "series", 100))

for _sort, _value in (("title", "sort_title"), ("author", "primary_author_sort")):
    query(f"book_jumps_{_sort}", f"""
WITH numbered AS (
  SELECT {_value} AS v, row_number() OVER (ORDER BY {ORDERS[_sort]}) - 1 AS spot, count(*) OVER () AS total
  FROM {{books}} WHERE deleted_at IS NULL),
labelled AS (
  SELECT CASE WHEN regexp_matches(v, '^\\p{{L}}') THEN upper(substr(v, 1, 1))
              WHEN regexp_matches(v, '^\\p{{Nd}}') THEN '0–9' ELSE '#' END AS label, spot, total FROM numbered)
SELECT label, CAST(min(spot) AS BIGINT) AS "offset", CAST(max(total) AS BIGINT) AS total FROM labelled GROUP BY label
""".replace("{L}", "{{L}}").replace("{Nd}", "{{Nd}}"))(lambda c, s=_sort: browse.book_jumps(c.books, s))

for _sort in ("title", "series"):
    query(f"sequence_window_{_sort}", f"""
WITH o AS (SELECT id, title, row_number() OVER (ORDER BY {ORDERS[_sort]}) AS rn, count(*) OVER () AS total
           FROM {{books}} WHERE deleted_at IS NULL),
cur AS (SELECT rn FROM o WHERE id = 501)
SELECT o.id, o.title, CAST(o.rn AS BIGINT) AS rn, o.total, o.id = 501 AS is_current
FROM o, cur WHERE o.rn BETWEEN cur.rn - 10 AND cur.rn + 15""")(
        lambda c, s=_sort: browse.sequence_window(browse.live(c.books), browse.list_keys(s), 501, 10, 15))

query("book_detail", """
SELECT b.id, b.title, b.sort_title, b.series, b.series_index, b.language, b.publisher, b.published_date,
       coalesce(a.authors, '') AS authors, coalesce(t.genres, '') AS genres, coalesce(t.tags, '') AS tags,
       coalesce(s.n, 0) AS n_assets, CAST(coalesce(s.bytes, 0) AS BIGINT) AS bytes
FROM {books} b
LEFT JOIN (SELECT ba.book_id, string_agg(a.name, '; ' ORDER BY ba.author_order, ba.author_id) AS authors
           FROM {book_authors} ba JOIN {authors} a ON a.id = ba.author_id GROUP BY ba.book_id) a ON a.book_id = b.id
LEFT JOIN (SELECT bt.book_id,
                  string_agg(CASE WHEN t.kind = 'genre' THEN t.name END, ', ' ORDER BY bt.position, bt.tag_id) AS genres,
                  string_agg(CASE WHEN t.kind = 'tag' THEN t.name END, ', ' ORDER BY bt.position, bt.tag_id) AS tags
           FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id GROUP BY bt.book_id) t ON t.book_id = b.id
LEFT JOIN (SELECT book_id, count(*) AS n, sum(coalesce(current_size, original_size, 0)) AS bytes
           FROM {assets} GROUP BY book_id) s ON s.book_id = b.id
WHERE b.deleted_at IS NULL""")(
    lambda c: browse.book_detail(c.books, c.authors, c.book_authors, c.tags, c.book_tags, c.assets))

for _order, _sql in (("title", ORDERS["title"]), ("recent", "added_at DESC, id DESC")):
    query(f"publications_{_order}", f"""
SELECT CAST(rn AS BIGINT) AS rn, {PUBLICATION} FROM (
  SELECT *, row_number() OVER (ORDER BY {_sql}) AS rn FROM {{books}}
  WHERE deleted_at IS NULL AND id IN (SELECT book_id FROM {{assets}})) q WHERE rn > 50 AND rn <= 250""")(
        lambda c, o=_order: browse.list_publications(c.books, c.assets, o, 200, 50))

query("publications_count", """
SELECT count(*) AS n FROM {books} WHERE deleted_at IS NULL AND id IN (SELECT book_id FROM {assets})""")(
    lambda c: browse.publications(c.books, c.assets).agg(F.count(F.lit(1)).alias("n")))

query("shelf_publications", f"""
SELECT CAST(rn AS BIGINT) AS rn, {PUBLICATION} FROM (
  SELECT b.*, row_number() OVER (ORDER BY s.position, s.added_at DESC, b.added_at DESC, b.id) AS rn
  FROM {{books}} b JOIN {{shelf_books}} s ON s.book_id = b.id
  WHERE s.shelf_id = 7 AND b.deleted_at IS NULL AND b.id IN (SELECT book_id FROM {{assets}})) q WHERE rn <= 200""")(
    lambda c: browse.page(browse.shelf_publications(c.books, c.assets, c.shelf_books, 7),
                          browse.shelf_keys("position"), 200).select("rn", *browse.PUBLICATION))

query("shelf_publications_count", """
SELECT s.shelf_id, count(*) AS n FROM {books} b JOIN {shelf_books} s ON s.book_id = b.id
WHERE b.deleted_at IS NULL AND b.id IN (SELECT book_id FROM {assets}) GROUP BY s.shelf_id""")(
    lambda c: c.shelf_books.join(browse.publications(c.books, c.assets).select(F.col("id").alias("book_id")), "book_id", "left_semi")
    .groupBy("shelf_id").agg(F.count(F.lit(1)).alias("n")))

TAGGED = """
  SELECT bt.book_id FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id
  WHERE t.name_key = 'asia' OR starts_with(t.name_key, 'asia.')"""
query("tag_publications", f"""
SELECT CAST(rn AS BIGINT) AS rn, {PUBLICATION} FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDERS['title']}) AS rn FROM {{books}}
  WHERE deleted_at IS NULL AND id IN (SELECT book_id FROM {{assets}}) AND id IN ({TAGGED})) q WHERE rn <= 200""")(
    lambda c: browse.page(browse.tag_publications(c.books, c.assets, c.tags, c.book_tags, " Asia "),
                          browse.list_keys("title"), 200).select("rn", *browse.PUBLICATION))
query("tag_publications_count", f"""
SELECT count(*) AS n FROM {{books}} WHERE deleted_at IS NULL AND id IN (SELECT book_id FROM {{assets}}) AND id IN ({TAGGED})""")(
    lambda c: browse.tag_publications(c.books, c.assets, c.tags, c.book_tags, " Asia ").agg(F.count(F.lit(1)).alias("n")))

query("series_counts", f"""
SELECT CAST(row_number() OVER (ORDER BY {low('series')}, series) AS BIGINT) AS rn, series, book_count FROM (
  SELECT series, count(*) AS book_count FROM {{books}}
  WHERE deleted_at IS NULL AND series IS NOT NULL AND trim(series) <> ''
    AND contains({low('series')}, 'brand') AND ({low('series')} > 'brand#12' OR ({low('series')} = 'brand#12' AND series > 'BRAND#12'))
  GROUP BY series) q QUALIFY rn <= 20""")(
    lambda c: browse.series_counts(c.books, "BRAND", "BRAND#12", 20))

query("series_cards", f"""
WITH r AS (
  SELECT b.series, b.id, b.cover_version, coalesce(f.name, '') AS author,
         row_number() OVER (PARTITION BY b.series ORDER BY CASE WHEN b.cover_version > 0 THEN 0 ELSE 1 END, {VOLUME}, b.id) AS place,
         sum(CASE WHEN s.status = 'finished' THEN 1 ELSE 0 END) OVER (PARTITION BY b.series) AS finished_count,
         count(*) OVER (PARTITION BY b.series) AS book_count
  FROM {{books}} b LEFT JOIN {{first_author}} f ON f.book_id = b.id
  LEFT JOIN {{reading_state}} s ON s.book_id = b.id AND s.user_id = 5
  WHERE b.deleted_at IS NULL AND trim(b.series) <> '')
SELECT CAST(row_number() OVER (ORDER BY {low('series')}, series) AS BIGINT) AS rn, series, book_count,
       CAST(finished_count AS BIGINT) AS finished_count, id AS cover_book_id, cover_version, author
FROM r WHERE place = 1""")(lambda c: browse.series_cards(c.books, c.first_author, c.reading_state, 5, None))

query("author_counts", f"""
SELECT CAST(rn AS BIGINT) AS rn, name, sort_name, book_count FROM (
  SELECT name, sort_name, book_count, row_number() OVER (ORDER BY {low('sort_name')}, name) AS rn FROM (
    SELECT a.name, a.sort_name, count(*) AS book_count FROM {{authors}} a JOIN {{book_authors}} ba ON ba.author_id = a.id
    JOIN {{books}} b ON b.id = ba.book_id WHERE b.deleted_at IS NULL GROUP BY a.id, a.name, a.sort_name) x
  WHERE {low('sort_name')} > 'moreau 15, dmitri') q WHERE rn <= 60""")(
    lambda c: browse.author_counts(c.books, c.authors, c.book_authors, 60, ("Moreau 15, Dmitri", "zzz")))

query("author_info", """
SELECT a.name, a.sort_name, count(*) AS book_count FROM {authors} a JOIN {book_authors} ba ON ba.author_id = a.id
JOIN {books} b ON b.id = ba.book_id WHERE b.deleted_at IS NULL AND a.name = 'Boris novak 1' GROUP BY a.name, a.sort_name""")(
    lambda c: browse.author_info(c.books, c.authors, c.book_authors, "Boris novak 1"))

query("author_names", f"""
SELECT CAST(row_number() OVER (ORDER BY {low('sort_name')}, name) AS BIGINT) AS rn, name, sort_name FROM {{authors}}
WHERE contains({low('name')}, 'ova') AND id IN (SELECT ba.author_id FROM {{book_authors}} ba JOIN {{books}} b ON b.id = ba.book_id
  WHERE b.deleted_at IS NULL) QUALIFY rn <= 50""")(
    lambda c: browse.author_names(c.books, c.authors, c.book_authors, "OVA", 50))

query("primary_author", """
SELECT book_id, author_id, name, sort_name FROM (
  SELECT ba.book_id, ba.author_id, a.name, a.sort_name,
         row_number() OVER (PARTITION BY ba.book_id ORDER BY ba.author_order, ba.author_id) AS rn
  FROM {book_authors} ba JOIN {authors} a ON a.id = ba.author_id) q WHERE rn = 1""")(
    lambda c: browse.primary_author(c.authors, c.book_authors))

BRANCHES = """
b AS (SELECT t.id, t.name, t.name_key, t.kind, t.parent_id, count(DISTINCT x.book_id) AS book_count,
             bool_or(d.id <> t.id) AS has_children
      FROM {tags} t JOIN {tags} d ON d.kind = t.kind AND (d.id = t.id OR starts_with(d.name_key, t.name_key || '.'))
      JOIN {book_tags} x ON x.tag_id = d.id JOIN {books} k ON k.id = x.book_id AND k.deleted_at IS NULL
      GROUP BY t.id, t.name, t.name_key, t.kind, t.parent_id)"""
query("tag_counts_roots", f"""
WITH {BRANCHES} SELECT CAST(row_number() OVER (ORDER BY name_key) AS BIGINT) AS rn, id, name, name_key, book_count, has_children
FROM b WHERE kind = 'genre' AND parent_id IS NULL""")(lambda c: browse.tag_counts(c.books, c.tags, c.book_tags, "genre"))
query("tag_counts_children", f"""
WITH {BRANCHES} SELECT CAST(row_number() OVER (ORDER BY book_count DESC, name_key) AS BIGINT) AS rn, id, name, name_key, book_count, has_children
FROM b WHERE kind = 'tag' AND parent_id = 3005 AND (book_count < 40 OR (book_count = 40 AND name_key > 'shelf')) QUALIFY rn <= 40""")(
    lambda c: browse.tag_counts(c.books, c.tags, c.book_tags, "tag", "Shelf.small", sort="books", after=("shelf", 40), limit=40))
query("tag_counts_search", f"""
WITH {BRANCHES} SELECT CAST(row_number() OVER (ORDER BY name_key) AS BIGINT) AS rn, id, name, name_key, book_count, has_children
FROM b WHERE kind = 'tag' AND contains(name_key, 'size 1') AND name_key > 'shelf.l' QUALIFY rn <= 50""")(
    lambda c: browse.tag_counts(c.books, c.tags, c.book_tags, "tag", q=" SIZE 1", after=("shelf.l", 0), limit=50))
query("list_tags", f"WITH {BRANCHES} SELECT name FROM b WHERE kind = 'tag' AND contains(name_key, 'small')")(
    lambda c: browse.list_tags(c.books, c.tags, c.book_tags, "tag", "Small"))
query("tag_branch", """
WITH RECURSIVE branch(id, depth) AS (
  SELECT id, CAST(0 AS BIGINT) FROM {tags} WHERE id = 3000
  UNION ALL SELECT t.id, branch.depth + 1 FROM {tags} t JOIN branch ON t.parent_id = branch.id)
SELECT t.id, t.name, t.kind, branch.depth FROM branch JOIN {tags} t ON t.id = branch.id""")(
    lambda c: browse.tag_branch(c.tags, 3000))

query("list_shelves_full", f"""
SELECT CAST(row_number() OVER (ORDER BY visibility <> 'shared', position, {low('name')}, id) AS BIGINT) AS rn,
       id AS shelf_id, name, kind, visibility, position
FROM {{shelves}} WHERE visibility = 'shared' OR owner_id = 8""")(
    lambda c: browse.page(browse.list_shelves(c.users, c.shelves, c.user_scope_shelves, 8), browse.shelf_order(), None))
query("list_shelves_scoped", f"""
SELECT CAST(row_number() OVER (ORDER BY visibility <> 'shared', position, {low('name')}, id) AS BIGINT) AS rn,
       id AS shelf_id, name, kind, visibility, position
FROM {{shelves}} WHERE (visibility = 'personal' AND owner_id = 19)
   OR (visibility = 'shared' AND id IN (SELECT shelf_id FROM {{user_scope_shelves}} WHERE user_id = 19))""")(
    lambda c: browse.page(browse.list_shelves(c.users, c.shelves, c.user_scope_shelves, 19), browse.shelf_order(), None))
query("shelf_memberships", """
SELECT s.id, s.name, s.visibility, s.position, b.book_id IS NOT NULL AS in_shelf
FROM {shelves} s LEFT JOIN {shelf_books} b ON b.shelf_id = s.id AND b.book_id = 44
WHERE s.kind = 'manual' AND (s.visibility = 'shared' OR s.owner_id = 8)""")(
    lambda c: browse.shelf_memberships(c.shelves, c.shelf_books, 8, 44))

query("continue_reading", f"""
WITH latest AS (
  SELECT a.book_id, p.asset_id, p.progress, p.updated_at,
         row_number() OVER (PARTITION BY a.book_id ORDER BY p.updated_at DESC, p.asset_id) AS n
  FROM {{reading_positions}} p JOIN {{assets}} a ON a.id = p.asset_id
  JOIN {{books}} b ON b.id = a.book_id AND b.deleted_at IS NULL
  JOIN {{reading_state}} s ON s.user_id = p.user_id AND s.book_id = a.book_id
  WHERE p.user_id = 57 AND p.updated_at > 0 AND p.progress < 0.995 AND s.status = 'reading')
SELECT CAST(row_number() OVER (ORDER BY l.updated_at DESC, b.id) AS BIGINT) AS rn, {', '.join('b.' + c for c in SUMMARY.split(', '))},
       l.asset_id, l.progress, l.updated_at
FROM latest l JOIN {{books}} b ON b.id = l.book_id WHERE l.n = 1 QUALIFY rn <= 8""")(
    lambda c: browse.continue_reading(c.books, c.assets, c.reading_positions, c.reading_state, 57))

query("trash_listing", """
SELECT CAST(row_number() OVER (ORDER BY b.deleted_at DESC, b.id) AS BIGINT) AS rn, b.id, b.title, b.deleted_at,
       coalesce(u.username, '') AS deleted_by_name
FROM {books} b LEFT JOIN {users} u ON u.id = b.deleted_by WHERE b.deleted_at IS NOT NULL""")(
    lambda c: browse.trash_listing(c.books, c.users))
query("trashed_ids", "SELECT id FROM {books} WHERE deleted_at IS NOT NULL")(lambda c: browse.trashed_ids(c.books))
query("trashed_assets", """
SELECT a.book_id, a.id, a.format, a.storage_path, coalesce(a.current_size, a.original_size, 0) AS bytes
FROM {assets} a JOIN {books} b ON b.id = a.book_id WHERE b.deleted_at IS NOT NULL""")(
    lambda c: browse.trashed_assets(c.books, c.assets))
query("storage_stats", """
SELECT (SELECT count(*) FROM {books} WHERE deleted_at IS NULL) AS books,
       (SELECT CAST(coalesce(sum(coalesce(a.current_size, a.original_size, 0)), 0) AS BIGINT) FROM {assets} a
        JOIN {books} b ON b.id = a.book_id WHERE b.deleted_at IS NULL) AS bytes""")(
    lambda c: browse.storage_stats(c.books, c.assets))
query("cleanup_counts", """
SELECT count(*) FILTER (cover_version <= 0) AS missing_cover,
       count(*) FILTER (id NOT IN (SELECT book_id FROM {book_authors})) AS missing_author,
       count(*) FILTER (id NOT IN (SELECT book_id FROM {book_tags})) AS no_genres_or_tags,
       count(*) FILTER (description IS NULL OR description = '') AS no_description
FROM {books} WHERE deleted_at IS NULL""")(lambda c: browse.cleanup_counts(c.books, c.book_authors, c.book_tags))
query("list_annotations", """
SELECT CAST(row_number() OVER (ORDER BY asset_id, created_at, id) AS BIGINT) AS rn, id, user_id, asset_id, book_id, role, quote, deleted, created_at
FROM {annotations} WHERE user_id = 7 AND book_id = 7 AND deleted = 0""")(
    lambda c: browse.list_annotations(c.annotations.drop("revision", "color"), 7, "book_id", 7))
