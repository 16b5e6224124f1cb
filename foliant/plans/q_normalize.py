"""Metadata normalisation over generated spellings of the provided rows.

Every oracle states the expected value from the parts a spelling was made of,
so it does not repeat the parsing it checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import dates, formats, identifiers, language, paths, people, tagging
from foliant.functions.text import let
from foliant.operators import browse, records
from foliant.plans.bindings import BINDINGS
from foliant.plans.registry import query

S = "CAST({} AS STRING)"
TWO = "lpad(CAST({} AS STRING), 2, '0')"
MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((m - 1) * 3 + 1 AS INT), 3)"

BINDINGS["raw_dates"] = f"""
SELECT id, kind, y, m, d, CASE kind
  WHEN 0 THEN {S.format('y')} || '-' || {S.format('m')} || '-' || {S.format('d')}
  WHEN 1 THEN {S.format('y')} || '/' || {TWO.format('m')} || '/' || {TWO.format('d')} || 'T10:00:00Z'
  WHEN 2 THEN {MON} || ' ' || {S.format('y')}
  WHEN 3 THEN {S.format('d')} || 'th ' || lower({MON}) || ' ' || {S.format('y')}
  WHEN 4 THEN {MON} || 'xyz ' || {S.format('d')} || ', ' || {S.format('y')}
  WHEN 5 THEN {S.format('y')} || '-' || {TWO.format('m')}
  WHEN 6 THEN '  ' || {S.format('y')} || ' '
  WHEN 7 THEN 'Published ' || {S.format('y')} || ' by Foo'
  ELSE 'undated item' END AS txt
FROM (SELECT o_orderkey AS id, o_orderkey % 9 AS kind, 1900 + o_orderkey % 150 AS y,
             CASE WHEN o_orderkey % 9 IN (2, 3, 4) THEN 1 + o_orderkey % 12 ELSE 1 + o_orderkey % 13 END AS m,
             1 + o_orderkey % 31 AS d FROM {{orders}}) p
"""
YMD = f"{S.format('y')} || '-' || {TWO.format('m')} || '-' || {TWO.format('d')}"
YM = f"{S.format('y')} || '-' || {TWO.format('m')}"
DATE_SQL = f"""
d AS (SELECT *, try_cast({YMD} AS DATE) IS NOT NULL AS real_day FROM {{raw_dates}}),
e AS (SELECT *, CASE WHEN kind IN (0, 1, 3, 4) AND real_day THEN {YMD} WHEN kind IN (2, 5) AND m <= 12 THEN {YM} WHEN kind = 6 THEN {S.format('y')} ELSE '' END AS normalized,
             CASE WHEN kind IN (0, 1, 3, 4) AND real_day THEN 'day' WHEN kind IN (2, 5) AND m <= 12 THEN 'month' WHEN kind = 6 THEN 'year' ELSE '' END AS precision,
             CASE WHEN kind = 8 THEN '' ELSE {S.format('y')} END AS any_year FROM d)"""
query("parse_partial_date", f"WITH {DATE_SQL} SELECT id, normalized, precision FROM e")(
    lambda c: c.raw_dates.select("id", dates.parse_partial_date(F.col("txt")).alias("p")).select("id", "p.normalized", "p.precision"))
query("normalize_metadata_date", f"WITH {DATE_SQL} SELECT id, CASE WHEN normalized <> '' THEN normalized ELSE any_year END AS date FROM e")(
    lambda c: c.raw_dates.select("id", dates.normalize_metadata_date(F.col("txt")).alias("date")))
query("format_year", f"WITH {DATE_SQL} SELECT id, any_year AS year FROM e")(
    lambda c: c.raw_dates.select("id", dates.format_year(F.col("txt")).alias("year")))
query("format_date_human", f"""
WITH {DATE_SQL}
SELECT id, CASE precision WHEN 'day' THEN strftime(CAST(normalized AS DATE), '%-d %B %Y')
                          WHEN 'month' THEN strftime(CAST(normalized || '-01' AS DATE), '%B %Y')
                          WHEN 'year' THEN normalized ELSE txt END AS shown FROM e""")(
    lambda c: c.raw_dates.select("id", dates.format_date_human(F.col("txt")).alias("shown")))

BINDINGS["raw_langs"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'eng' WHEN 1 THEN 'pt_BR' WHEN 2 THEN 'ZH-hant-hk' WHEN 3 THEN 'und'
  WHEN 4 THEN 'klingon' WHEN 5 THEN 'en--US' WHEN 6 THEN ' EN-us ' WHEN 7 THEN 'tlh' WHEN 8 THEN 'fra-' || CAST(100 + o_orderkey % 800 AS STRING)
  ELSE 'jp' END AS txt FROM {orders}
"""
query("normalize_language", """
SELECT id, CASE id % 10 WHEN 0 THEN 'en' WHEN 1 THEN 'pt-BR' WHEN 2 THEN 'zh-Hant-HK' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN ''
  WHEN 6 THEN 'en-US' WHEN 7 THEN 'tlh' WHEN 8 THEN 'fr-' || CAST(100 + id % 800 AS STRING) ELSE 'ja' END AS code FROM {raw_langs}""")(
    lambda c: c.raw_langs.select("id", language.normalize_language(F.col("txt")).alias("code")))
query("language_name", """
SELECT id, CASE id % 10 WHEN 0 THEN 'English' WHEN 1 THEN 'Portuguese (BR)' WHEN 2 THEN 'Chinese (Hant-HK)' WHEN 3 THEN 'und' WHEN 4 THEN 'klingon'
  WHEN 5 THEN 'en--US' WHEN 6 THEN 'English (US)' WHEN 7 THEN 'tlh' WHEN 8 THEN 'French (' || CAST(100 + id % 800 AS STRING) || ')' ELSE 'Japanese' END AS name FROM {raw_langs}""")(
    lambda c: c.raw_langs.select("id", language.language_name(F.col("txt")).alias("name")))
query("document_languages", """
SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS name,
       count(*) AS n FROM {documents} GROUP BY lang""")(
    lambda c: c.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("name", language.language_name(F.col("lang"))))

BINDINGS["raw_names"] = """
SELECT id, f, l, CASE id % 10
  WHEN 0 THEN f || ' ' || l
  WHEN 1 THEN 'Mrs. ' || f || ' Q. ' || l || ' III'
  WHEN 2 THEN f || ' [x] von ' || l || ' (III)'
  WHEN 3 THEN l || ' Inc.'
  WHEN 4 THEN l || ', ' || f
  WHEN 5 THEN l
  WHEN 6 THEN 'Dr. Prof.'
  WHEN 7 THEN '  ' || f || '   ' || l || ' Jr. '
  WHEN 8 THEN f || ' (a [b) c] d ' || l || ')'
  ELSE 'Sir ' || f || ' ' || l || ' Phd' END AS txt
FROM (SELECT o_orderkey AS id, 'Fay' || CAST(o_orderkey % 97 AS STRING) AS f, 'Lund' || CAST(o_custkey AS STRING) AS l FROM {orders}) n
"""
query("author_sort", """
SELECT id, CASE id % 10 WHEN 0 THEN l || ', ' || f WHEN 1 THEN l || ', ' || f || ' Q. III' WHEN 2 THEN l || ', ' || f || ' von'
  WHEN 7 THEN l || ', ' || f || ' Jr.' WHEN 8 THEN l || '), ' || f || ' d' WHEN 9 THEN l || ', ' || f || ' Phd' ELSE txt END AS sort_name FROM {raw_names}""")(
    lambda c: c.raw_names.select("id", people.author_sort(F.col("txt")).alias("sort_name")))

BINDINGS["raw_author_lists"] = """
SELECT id, f, l, CASE id % 6 WHEN 0 THEN f || ' & ' || l WHEN 1 THEN f || '; ' || l || ' ;; ' WHEN 2 THEN f || '&' || l
  WHEN 3 THEN f || ' && ' || l || ' & x' WHEN 4 THEN l || ', ' || f || ';' || f ELSE ' ; & ' END AS txt FROM {raw_names}
"""
query("parse_author_list", """
SELECT id, CASE id % 6 WHEN 0 THEN f || '|' || l WHEN 1 THEN f || '|' || l WHEN 2 THEN f || '&' || l WHEN 3 THEN f || ' & ' || l || '|x'
  WHEN 4 THEN l || ', ' || f || '|' || f ELSE '' END AS names FROM {raw_author_lists}""")(
    lambda c: c.raw_author_lists.select("id", F.array_join(people.parse_author_list(F.col("txt")), "|").alias("names")))
query("format_author_list", """
SELECT id, CASE id % 6 WHEN 0 THEN f || '; ' || l WHEN 1 THEN f || '; ' || l WHEN 2 THEN f || '&&' || l WHEN 3 THEN f || ' && ' || l || '; x'
  WHEN 4 THEN l || ', ' || f || '; ' || f ELSE '' END AS text FROM {raw_author_lists}""")(
    lambda c: c.raw_author_lists.select("id", people.format_author_list(people.parse_author_list(F.col("txt"))).alias("text")))

# ISBN-13 bodies with a computed, and for every third row a wrong, check digit.
BINDINGS["raw_isbns"] = """
SELECT id, body, good, body || CAST(CASE WHEN id % 3 = 0 THEN (good + 1) % 10 ELSE good END AS STRING) AS isbn
FROM (SELECT id, body, (10 - (CAST(substr(body,1,1) AS BIGINT) + CAST(substr(body,3,1) AS BIGINT) + CAST(substr(body,5,1) AS BIGINT)
        + CAST(substr(body,7,1) AS BIGINT) + CAST(substr(body,9,1) AS BIGINT) + CAST(substr(body,11,1) AS BIGINT)
        + 3 * (CAST(substr(body,2,1) AS BIGINT) + CAST(substr(body,4,1) AS BIGINT) + CAST(substr(body,6,1) AS BIGINT)
        + CAST(substr(body,8,1) AS BIGINT) + CAST(substr(body,10,1) AS BIGINT) + CAST(substr(body,12,1) AS BIGINT))) % 10) % 10 AS good
      FROM (SELECT o_orderkey AS id, CAST(978000000000 + o_orderkey * 7919 + o_custkey AS STRING) AS body FROM {orders}) b) g
"""
query("valid_isbn", "SELECT id, isbn, id % 3 <> 0 AS ok FROM {raw_isbns}")(
    lambda c: c.raw_isbns.select("id", "isbn", identifiers.valid_isbn(
        F.concat(F.substring("isbn", 1, 3), F.lit("-"), F.substring("isbn", 4, 10), F.lit(" "))).alias("ok")))
query("valid_isbn_10", """
SELECT id, (10 * CAST(substr(t,1,1) AS BIGINT) + 9 * CAST(substr(t,2,1) AS BIGINT) + 8 * CAST(substr(t,3,1) AS BIGINT) + 7 * CAST(substr(t,4,1) AS BIGINT)
  + 6 * CAST(substr(t,5,1) AS BIGINT) + 5 * CAST(substr(t,6,1) AS BIGINT) + 4 * CAST(substr(t,7,1) AS BIGINT) + 3 * CAST(substr(t,8,1) AS BIGINT)
  + 2 * CAST(substr(t,9,1) AS BIGINT) + 10) % 11 = 0 AS ok
FROM (SELECT id, substr(body, 4, 9) AS t FROM {raw_isbns}) x""")(
    lambda c: c.raw_isbns.select("id", identifiers.valid_isbn(F.concat(F.substring("body", 4, 9), F.lit("x"))).alias("ok")))

BINDINGS["raw_ids"] = """
SELECT id, k, CASE id % 8 WHEN 0 THEN k WHEN 1 THEN 'https://doi.org/10.1/' || k || '?q=1' WHEN 2 THEN 'http://x.org/' || k
  WHEN 3 THEN 'ISBN ' || k WHEN 4 THEN 'urn:ISBN:' || k WHEN 5 THEN 'Amazon: B' || k || ' , , goodreads:' || k
  WHEN 6 THEN 'doi: 10.2/' || k ELSE 'urn:x' END AS txt
FROM (SELECT o_orderkey AS id, CAST(900000 + o_orderkey AS STRING) AS k FROM {orders}) n
"""
query("parse_identifiers", """
SELECT id, CASE id % 8 WHEN 0 THEN 'isbn:' || k WHEN 1 THEN 'doi:10.1/' || k WHEN 2 THEN 'url:http://x.org/' || k WHEN 3 THEN 'isbn:' || k
  WHEN 4 THEN 'isbn:' || k WHEN 5 THEN 'amazon:B' || k || ', goodreads:' || k WHEN 6 THEN 'doi:10.2/' || k ELSE 'urn:x' END AS ids FROM {raw_ids}""")(
    lambda c: c.raw_ids.select("id", identifiers.format_identifiers(identifiers.parse_identifiers(F.col("txt"))).alias("ids")))
query("identifier_from_scheme", """
SELECT id, CASE id % 8 WHEN 0 THEN 'isbn' WHEN 1 THEN 'amazon' WHEN 2 THEN 'url' WHEN 3 THEN 'goodreads' WHEN 4 THEN 'x-id' WHEN 5 THEN CASE WHEN id % 3 <> 0 THEN 'isbn' ELSE 'unknown' END
  WHEN 6 THEN 'unknown' ELSE '' END AS type,
  CASE id % 8 WHEN 0 THEN isbn WHEN 1 THEN isbn WHEN 2 THEN 'https://e.org/' || isbn WHEN 3 THEN isbn WHEN 4 THEN 'v' || isbn WHEN 5 THEN isbn WHEN 6 THEN 'urn:z:' || isbn ELSE '' END AS value
FROM {raw_isbns}""")(
    lambda c: c.raw_isbns.select("id", F.expr("CASE WHEN id % 8 = 4 THEN ' X-ID ' ELSE '' END").alias("scheme"), F.expr(
        "CASE id % 8 WHEN 0 THEN concat('URN:ISBN:', isbn) WHEN 1 THEN concat('asin:', isbn) WHEN 2 THEN concat('https://e.org/', isbn) "
        "WHEN 3 THEN concat('goodreads: ', isbn) WHEN 4 THEN concat('v', isbn) WHEN 5 THEN isbn WHEN 6 THEN concat('urn:z:', isbn) ELSE '  ' END").alias("v"))
    .select("id", identifiers.identifier_from_scheme(F.col("scheme"), F.col("v")).alias("i")).select("id", "i.type", "i.value"))
query("external_identifiers", """
SELECT id, 'isbn:' || isbn || ', x:' || 'A' || isbn AS ids FROM {raw_isbns}""")(
    lambda c: c.raw_isbns.select("id", identifiers.format_identifiers(identifiers.external_identifiers(identifiers.parse_identifiers(F.concat(
        F.lit("isbn:"), "isbn", F.lit(", uuid:7, calibre:"), "isbn", F.lit(", ISBN: "), "isbn", F.lit(", x:A"), "isbn", F.lit(", X:a"), "isbn",
        F.lit(", z:12345678-1234-1234-1234-"), F.lpad(F.col("id").cast("string"), 12, "0"))))).alias("ids")))

query("tag_key_parts", """
SELECT id, name_key AS key, len(string_split(name, '.')) AS depth, string_split(name, '.')[1] AS top FROM {tags}""")(
    lambda c: c.tags.select("id", tagging.tag_key(F.concat(F.lit("  "), F.replace("name", F.lit("."), F.lit(" . ")), F.lit(" "))).alias("key"),
                            F.size(tagging.tag_parts(F.col("name"))).cast("long").alias("depth"), tagging.tag_parts(F.col("name"))[0].alias("top")))
query("normalize_tag_list", """
SELECT o_orderkey AS id, 'Red' || k || '|Sea.' || k || '|a..b' AS names FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS k FROM {orders}) x""")(
    lambda c: c.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("k")).select("id", F.array_join(
        tagging.normalize_tag_list(F.concat(F.lit(" Red"), "k", F.lit(",, red"), "k", F.lit(",Sea . "), "k", F.lit(",a..b, SEA."), "k")), "|").alias("names")))
MODES = "CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'replace' ELSE 'clear' END"
query("apply_tag_mode", f"""
SELECT id, CASE mode WHEN 'add' THEN 'A' || k || '|B|c' WHEN 'remove' THEN 'B' WHEN 'replace' THEN 'a' || k || '|c' ELSE '' END AS names
FROM (SELECT o_orderkey AS id, {MODES} AS mode, CAST(o_custkey AS STRING) AS k FROM {{orders}}) x""")(
    lambda c: c.orders.selectExpr("o_orderkey AS id", f"{MODES} AS mode", "CAST(o_custkey AS STRING) AS k").select("id", F.array_join(
        tagging.apply_tag_mode(F.array(F.concat(F.lit("A"), "k"), F.lit("B")), F.col("mode"), F.array(F.concat(F.lit("a"), "k"), F.lit("c"))), "|").alias("names")))
query("merge_overrides", """
SELECT id, CASE WHEN manual_overrides IS NULL THEN '{{"series":true,"tags":true}}' ELSE '{{"series":true,"tags":true,"title":true}}' END AS overrides FROM {books}""")(
    lambda c: c.books.select("id", records.merge_overrides(F.col("manual_overrides"), F.array(F.lit("tags"), F.lit("series"))).alias("overrides")))
query("jump_label", """
SELECT id, CASE WHEN id % 5 = 0 THEN '0–9' WHEN id % 5 = 1 THEN '#' ELSE upper(substr(title, 1, 1)) END AS label FROM {books}""")(
    lambda c: c.books.select("id", browse.jump_label(F.expr(
        "CASE WHEN id % 5 = 0 THEN concat('7 ', title) WHEN id % 5 = 1 THEN concat('(', title) ELSE title END")).alias("label")))

query("classify_format", """
SELECT id, CASE WHEN id % 4 = 0 THEN '.fb2.zip' WHEN id % 4 = 1 THEN '.kepub.epub' WHEN id % 4 = 2 THEN extension ELSE '' END AS extension,
       CASE WHEN id % 4 = 0 THEN 'fb2' WHEN id % 4 = 1 THEN 'kepub' WHEN id % 4 = 2 THEN format ELSE 'unknown' END AS format,
       CASE WHEN id % 4 = 0 THEN 'application/zip' WHEN id % 4 = 1 THEN 'application/epub+zip' WHEN id % 4 = 3 THEN 'application/octet-stream'
            ELSE CASE format WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'mobi' THEN 'application/x-mobipocket-ebook'
                             WHEN 'fb2' THEN 'application/x-fictionbook+xml' ELSE 'application/epub+zip' END END AS media_type
FROM {assets}""")(
    lambda c: c.assets.select("id", formats.classify_format(F.expr(
        "CASE WHEN id % 4 = 0 THEN concat(filename, '.FB2.zip') WHEN id % 4 = 1 THEN concat(filename, '.kepub.EPUB') WHEN id % 4 = 2 THEN upper(filename) ELSE concat(filename, '.doc') END"
    )).alias("f")).select("id", "f.extension", "f.format", "f.media_type"))
query("filename_metadata", """
SELECT id, CASE WHEN id % 4 < 2 THEN 'T ' || CAST(id AS STRING) END AS title, CASE WHEN id % 4 < 2 THEN 'Some Body' END AS author,
       CASE WHEN id % 4 = 0 THEN CASE WHEN id % 3 <> 0 THEN 'isbn:' || isbn ELSE '' END WHEN id % 4 = 1 THEN '' END AS identifier FROM {raw_isbns}""")(
    lambda c: c.raw_isbns.select("id", formats.filename_metadata(F.expr(
        "concat('dir/T  ', id, ' -- Some Body -- House -- ', CASE id % 4 WHEN 0 THEN concat('1990 -- ISBN-13: ', isbn) WHEN 1 THEN '2001' WHEN 2 THEN 'Tor' ELSE '' END, '.epub')"
    )).alias("m")).select("id", "m.title", "m.author", "m.identifier"))

BINDINGS["path_rows"] = """
SELECT a.id AS asset_id, a.book_id, a.extension, a.original_filename, a.storage_path, b.title, b.sort_title, coalesce(b.series, '') AS series,
       CASE WHEN b.series_index IS NULL THEN '' ELSE CAST(CAST(b.series_index AS BIGINT) AS STRING) END AS series_index,
       coalesce(f.name, '') AS author, coalesce(f.sort_name, '') AS author_sort
FROM {assets} a JOIN {books} b ON b.id = a.book_id LEFT JOIN {first_author} f ON f.book_id = b.id
"""
TEMPLATE = "{author_bucket}/{author_sort}/{series|solo} {series_index}/{title}: [a{asset_id}]{dot_ext}"
PATH_SQL = """CASE WHEN author_sort = '' THEN '_Unknown/Unknown Author' ELSE upper(substr(author_sort, 1, 1)) || '/' || author_sort END
  || '/' || trim(CASE WHEN series = '' THEN 'solo' ELSE series END || ' ' || series_index) || '/' || title || ' [a' || CAST(asset_id AS STRING) || ']' || extension"""


def path_columns() -> dict:
    names = ("title", "sort_title", "author", "author_sort", "series", "series_index", "asset_id", "book_id", "original_filename")
    return {**{n: F.col(n) for n in names}, "ext": F.col("extension")}


query("render_book_path", f"SELECT asset_id, {PATH_SQL} AS path FROM {{path_rows}}")(
    lambda c: c.path_rows.select("asset_id", paths.render_book_path(TEMPLATE, path_columns()).alias("path")))
query("render_book_path_long", """
SELECT doc_id AS id, strlen(text) > 255 AS was_long FROM {documents} WHERE trim(regexp_replace(text, '[<>:"/\\\\|?*\\s.]', '', 'g')) <> ''""")(
    # An exploded segment is made once for each row; as a plain column the filter would make it again, before the rows are dealt over the cores.
    lambda c: c.documents.select(F.col("doc_id").alias("id"), (F.octet_length("text") > 255).alias("was_long"),
                                 F.explode(F.array(let(paths.safe_segment(F.col("text")), paths.short_segment))).alias("seg"))
    .where("seg <> '' AND octet_length(seg) <= 255").select("id", "was_long"))

# --- choosing among records ----------------------------------------------------------
BINDINGS["creators"] = """
SELECT l_partkey + 1 AS book_id, l_orderkey * 10 + l_linenumber AS idx, 'N' || CAST(l_suppkey AS STRING) AS name,
       CASE WHEN l_suppkey % 4 = 0 THEN 'A & B' WHEN l_suppkey % 4 = 1 THEN 'S' || CAST(l_suppkey AS STRING) END AS file_as,
       CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_returnflag = 'A' THEN 'AUT' WHEN l_returnflag = 'N' THEN 'edt' ELSE 'trl' END
            WHEN l_partkey % 3 = 1 THEN CASE WHEN l_returnflag = 'A' THEN '' ELSE 'marc:edt' END ELSE 'edt' END AS role,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END AS display_seq,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
FROM {lineitem}
"""
ROLE_RANK = "CASE WHEN lower(role) = 'aut' THEN 1 WHEN role = '' THEN 2 WHEN lower(role) IN ('edt', 'marc:edt') THEN 3 END"
query("select_contributors", f"""
WITH r AS (SELECT *, {ROLE_RANK} AS rank, min({ROLE_RANK}) OVER (PARTITION BY book_id) AS best FROM {{creators}}),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY display_seq IS NULL, display_seq, idx, cents, name) - 1 AS place FROM r WHERE rank = best)
SELECT book_id, CAST(count(*) AS BIGINT) AS n, CAST(max(place) AS BIGINT) AS last_place,
       min_by(name, place) AS first_name, min_by(CASE WHEN coalesce(file_as, '') LIKE '% & %' THEN '' ELSE coalesce(file_as, '') END, place) AS first_sort,
       CASE WHEN max(rank) = 1 THEN 'aut' WHEN max(rank) = 2 THEN '' ELSE 'edt' END AS role
FROM n GROUP BY book_id""")(
    lambda c: records.select_contributors(c.creators.withColumn("idx", F.col("idx") * 10000000 + F.col("cents") % 10000000)
                                          .withColumn("refined_roles", F.lit(None).cast("array<string>")))
    .groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last_place"), F.min_by("name", "place").alias("first_name"),
                            F.min_by("sort_name", "place").alias("first_sort"), F.max("role").alias("role")))

BINDINGS["collections"] = """
SELECT l_partkey + 1 AS book_id, (l_orderkey * 10 + l_linenumber) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000 AS idx,
       'C' || CAST(l_suppkey AS STRING) AS name, CASE l_linenumber WHEN 1 THEN 'series' WHEN 2 THEN 'set' END AS collection_type,
       CASE WHEN l_linenumber > 5 THEN l_quantity END AS position
FROM {lineitem} WHERE l_partkey % 2 = 0 OR l_linenumber > 1
"""
query("select_series", """
SELECT book_id, name AS series, coalesce(position, 0.0) AS series_index FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN collection_type = 'series' THEN 1 ELSE 2 END, idx) AS n
  FROM {collections} WHERE collection_type = 'series' OR (collection_type IS NULL AND position IS NOT NULL)) q WHERE n = 1""")(
    lambda c: records.select_series(c.collections))

BINDINGS["date_records"] = """
SELECT o_custkey + 1 AS book_id, o_orderkey AS idx,
       CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(1900 + o_orderkey % 120 AS STRING) || '-05' END AS text,
       CASE o_orderstatus WHEN 'F' THEN 'modification' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Publication' ELSE '' END ELSE 'original-publication' END AS event
FROM {orders}
"""
query("select_publication_date", """
SELECT book_id, text AS published_date FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE event WHEN 'Publication' THEN 1 WHEN '' THEN 2 ELSE 3 END, idx) AS n
  FROM {date_records} WHERE event <> 'modification' AND text <> 'unknown') q WHERE n = 1""")(
    lambda c: records.select_publication_date(c.date_records))

BINDINGS["page_metas"] = """
SELECT o_custkey + 1 AS book_id, o_orderkey AS idx,
       CASE o_orderkey % 5 WHEN 0 THEN 'Schema:NumberOfPages' WHEN 1 THEN 'calibre:user_metadata:#pages' WHEN 2 THEN 'calibre:user_metadata' WHEN 3 THEN 'bookorbit:page_count' ELSE 'dc:other' END AS key,
       CASE o_orderkey % 5 WHEN 1 THEN '{{"#value#": "' || CAST(o_orderkey % 900 AS STRING) || '"}}'
            WHEN 2 THEN '{{"#pagecount": {{"#value#": ' || CAST(o_orderkey % 700 AS STRING) || '}}}}'
            ELSE CASE WHEN o_orderkey % 4 = 0 THEN '-1' ELSE ' ' || CAST(o_orderkey % 800 AS STRING) || ' ' END END AS value,
       CASE WHEN o_orderkey % 10 = 0 THEN '#x' ELSE '' END AS refines
FROM {orders}
"""
query("select_page_count", """
SELECT book_id, CAST(n AS BIGINT) AS page_count FROM (
  SELECT book_id, n, row_number() OVER (PARTITION BY book_id ORDER BY rank, idx) AS place FROM (
    SELECT book_id, idx, CASE idx % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 END AS rank,
           CASE idx % 5 WHEN 1 THEN idx % 900 WHEN 2 THEN idx % 700 ELSE CASE WHEN idx % 4 = 0 THEN -1 ELSE idx % 800 END END AS n
    FROM {page_metas} WHERE refines = '' AND idx % 5 <> 4) r WHERE n > 0) q WHERE place = 1""")(
    lambda c: records.select_page_count(c.page_metas))
query("choose_page_count", """
SELECT id, CASE WHEN id % 3 = 0 OR id % 10 = 1 OR format = 'pdf' THEN coalesce(page_count, 0) WHEN format IN ('epub', 'kepub', 'fb2') THEN id % 300 + 1
                WHEN coalesce(page_count, 0) = 0 THEN id % 300 + 1 ELSE page_count END AS pages FROM {assets}""")(
    lambda c: c.assets.select("id", records.choose_page_count(
        F.col("format"), F.coalesce("page_count", F.lit(0)), F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 300 + 1 END"), F.expr("id % 10 = 1")).alias("pages")))
query("classify_subjects", """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Novel' || k ELSE 'Sci-Fi|S' || k END AS genres,
       CASE o_orderkey % 3 WHEN 0 THEN 'Sci-Fi|S' || k || '|e' || k WHEN 1 THEN 'e' || k || '|b' END AS tags
FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS k FROM {orders}) x""")(
    lambda c: c.orders.selectExpr("o_orderkey AS id", "CAST(o_custkey AS STRING) AS k").select("id", records.classify_subjects(
        F.array(F.concat(F.lit("Sci-Fi, S"), "k"), F.lit("sci-fi")),
        F.expr("CASE WHEN id % 3 = 0 THEN concat('{\"#value#\": [\"Novel', k, '\"]}') END"),
        F.expr("CASE WHEN id % 3 = 0 THEN concat('{\"#value#\": \"e', k, '\"}') WHEN id % 3 = 1 THEN concat('{\"#value#\": \"e', k, ',b\"}') ELSE '[]' END")).alias("o"))
    .select("id", F.array_join("o.genres", "|").alias("genres"), F.array_join("o.tags", "|").alias("tags")))
