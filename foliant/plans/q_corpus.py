"""Text and page corpus jobs over the whole documents and pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import markup, prose
from foliant.operators import corpus
from foliant.plans.bindings import ORACLE_ONLY
from foliant.plans.registry import query
from foliant.sources import files
from foliant.sources.catalog import Catalog

LATIN = r"^[\x00-\x7f\xa0-\xff]*$"


def encoded_documents(c: Catalog) -> DataFrame:
    """The documents as bytes: UTF-8 with and without mark, UTF-16 both ways, and a single-byte code page.

    Texts with three accented letters in a row would rightly be taken for
    Cyrillic in a single-byte page, so they stay UTF-8.
    """
    text = F.col("text")
    mark = lambda h: F.unhex(F.lit(h))
    raw = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")))
        .when(F.col("doc_id") % 5 == 1, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")))
        .when(F.col("doc_id") % 5 == 2, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .when((F.col("doc_id") % 5 == 3) & text.rlike(LATIN) & ~text.rlike(r"[\x80-\xff]{3}"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    )
    return c.documents.select("doc_id", raw.alias("raw"))


query("decode_text", "SELECT doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM {documents}")(
    lambda c: encoded_documents(c).select("doc_id", prose.decode_text(F.col("raw")).alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n")))
query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM {documents}")(
    lambda c: c.documents.select("doc_id", files.content_hash(F.encode("text", "UTF-8")).alias("hash")))
query("sampled_md5", """
SELECT doc_id, md5(b[1:1024] || b[1025:2048] || b[4097:5120] || b[16385:17408] || b[65537:66560] || b[262145:263168]) AS hash
FROM (SELECT doc_id, encode(text) AS b FROM {documents}) x""")(
    lambda c: c.documents.select("doc_id", files.sampled_md5(F.encode("text", "UTF-8")).alias("hash")))
query("clean_text", "SELECT doc_id, md5(replace(text, '. ', '.' || chr(10))) AS digest FROM {documents}")(
    lambda c: c.documents.select("doc_id", F.md5(prose.clean_text(F.replace("text", F.lit(". "), F.lit(".\x07\r\n")))).alias("digest")))

# Every second document gets blank lines, so that both readings of a text occur.
ORACLE_ONLY["doc_lines"] = """
SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) ELSE text END, chr(10)) AS ls FROM {documents}) x"""
ORACLE_ONLY["doc_inner"] = """
SELECT l.*, trim(l.line) = '' AS blank, n.lo, n.hi FROM {doc_lines} l
JOIN (SELECT doc_id, min(i) AS lo, max(i) AS hi FROM {doc_lines} WHERE trim(line) <> '' GROUP BY doc_id) n ON n.doc_id = l.doc_id WHERE l.i BETWEEN n.lo AND n.hi"""
query("paragraphs", r"""
WITH k AS (SELECT doc_id, count(*) >= 6 AND NOT bool_or(blank) AND 3 * count(*) FILTER (regexp_matches(rtrim(trim(line), ' ''"”’)]}}'), '[.!?:;]$')) >= 2 * count(*) AS by_line FROM {doc_inner} GROUP BY doc_id),
g AS (SELECT d.doc_id, d.i, d.line, k.by_line, CASE WHEN k.by_line THEN d.i ELSE sum(CASE WHEN d.blank THEN 1 ELSE 0 END) OVER (PARTITION BY d.doc_id ORDER BY d.i) END AS grp, d.blank
      FROM {doc_inner} d JOIN k ON k.doc_id = d.doc_id),
p AS (SELECT doc_id, grp, string_agg(CASE WHEN by_line THEN trim(line) ELSE rtrim(line, ' ' || chr(9)) END, ' ' ORDER BY i) AS paragraph FROM g WHERE NOT blank GROUP BY doc_id, grp)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS BIGINT) AS place, md5(paragraph) AS digest FROM p""")(
    lambda c: corpus.paragraph_rows(c.documents.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n \n"))).otherwise(F.col("text"))),
                                    "doc_id", "text").select("doc_id", "place", F.md5("paragraph").alias("digest")))
query("sentences", r"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS place, md5(unnest(s)) AS digest
FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(?:[^.!?…。！？]*[.!?…。！？][.!?…。！？''"”’“)\]}}]*\s?|[^.!?…。！？]+$)') AS s FROM {documents}) x""")(
    lambda c: corpus.sentence_rows(c.documents, "doc_id", "text").select("doc_id", "place", F.md5("sentence").alias("digest")))
query("outline_markdown", r"""
WITH h AS (SELECT doc_id, i - 1 AS line, trim(l) AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {documents}) x WHERE trim(l) <> ''),
s AS (SELECT *, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{Nd}}]+', '-', 'g'), '-') AS base FROM h),
n AS (SELECT *, CASE WHEN base = '' THEN 'heading-' || CAST(line AS VARCHAR) WHEN regexp_matches(base, '^\p{{L}}') THEN base ELSE 'heading-' || base END AS slug FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line) AS k FROM n)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(line % 3 + 1 AS BIGINT) AS level, md5(title) AS title, md5(CASE WHEN k = 1 THEN slug ELSE slug || '-' || CAST(k AS VARCHAR) END) AS anchor FROM r""")(
    lambda c: corpus.outline(c.documents.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(
        F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "), s)), "\n")), "doc_id", prose.heading_lines(F.col("text"))).select(
        "doc_id", "line", "level", F.md5("title").alias("title"), F.md5("anchor").alias("anchor")))
query("outline_html", r"""
SELECT page_id, CAST(0 AS BIGINT) AS line, CAST(1 AS BIGINT) AS level, md5(title) AS title
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>.*?</h1\s*>'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM {pages}) x WHERE title <> ''""")(
    lambda c: corpus.outline(c.pages, "page_id", corpus.html_headings(F.col("html"))).where("title <> ''").select("page_id", "line", "level", F.md5("title").alias("title")))
query("estimate_pages_text", r"""
WITH w AS (SELECT doc_id, list_concat(list_transform(list_filter(string_split_regex(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN trim(l) = '' THEN chr(1) ELSE l END), ' '), '\s+'), lambda x: x <> ''),
             lambda x: CASE WHEN x = chr(1) THEN -1 ELSE CAST(length(x) AS BIGINT) END), [CAST(-1 AS BIGINT)]) AS ws FROM {documents})
SELECT doc_id, CAST(ceil((list_reduce(ws, lambda s, x: CASE
    WHEN x < 0 THEN CASE WHEN s % 1000 > 0 THEN (s // 1000 + 1) * 1000 ELSE s END
    WHEN s % 1000 > 0 AND s % 1000 + 1 + x > 70 THEN (s // 1000 + 1 + CASE WHEN x > 70 THEN (x - 1) // 70 ELSE 0 END) * 1000 + CASE WHEN x > 70 THEN (x - 1) % 70 + 1 ELSE x END
    WHEN s % 1000 > 0 THEN s + 1 + x
    ELSE (s // 1000 + CASE WHEN x > 70 THEN (x - 1) // 70 ELSE 0 END) * 1000 + CASE WHEN x > 70 THEN (x - 1) % 70 + 1 ELSE x END END, CAST(0 AS BIGINT)) // 1000) / 36.0) AS BIGINT) AS pages FROM w""")(
    lambda c: c.documents.select("doc_id", prose.estimate_pages_text(F.col("text")).alias("pages")))
def search_rows(c: Catalog) -> DataFrame:
    """'the' followed by a space; the query itself is trimmed, so a mark stands for the space."""
    marked = c.documents.select("doc_id", F.col("text"), F.regexp_replace("text", "(?i)(the) ", "$1\x02").alias("marked"))
    found = marked.select("doc_id", "text", F.explode(prose.search_in_text(F.col("marked"), "the\x02")).alias("m"))
    back = lambda c: F.replace(F.col(c), F.lit("\x02"), F.lit(" "))
    return found.select("doc_id", "m.at", F.md5(back("m.pre")).alias("pre"), back("m.match").alias("match"), F.md5(back("m.post")).alias("post"))


query("search_in_book", """
WITH p AS (SELECT doc_id, text, string_split(lower(text), 'the ') AS parts FROM {documents}),
m AS (SELECT doc_id, text, unnest(generate_series(1, len(parts) - 1)) AS k, parts FROM p WHERE len(parts) > 1),
a AS (SELECT doc_id, text, CAST(list_sum(list_transform(parts[1:k], lambda s: length(s))) + (k - 1) * 4 AS BIGINT) AS pos FROM m)
SELECT doc_id, pos AS at, md5(CASE WHEN pos > 72 THEN '…' ELSE '' END || substr(text, greatest(pos - 72, 0) + 1, pos - greatest(pos - 72, 0))) AS pre, substr(text, pos + 1, 4) AS match,
       md5(substr(text, pos + 5, least(72, length(text) - pos - 4)) || CASE WHEN pos + 76 < length(text) THEN '…' ELSE '' END) AS post FROM a""".replace(" AS at,", ' AS "at",'))(
    search_rows)


# --- pages ---------------------------------------------------------------------------
UNESCAPE = r"""replace(replace(replace(replace(regexp_replace({}, '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), chr(1), '&')"""
TOKENS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|<[^>]*>|[^<]+|<"
BLOCK_SQL = r"(?i)^</?(?:" + "|".join(markup.BLOCKS) + r")\b"
query("html_to_text", rf"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '{TOKENS}') AS toks FROM {{pages}}),
x AS (SELECT page_id, array_to_string(list_transform(toks, lambda t: CASE WHEN starts_with(t, '<!--') THEN ''
        WHEN regexp_matches(t, '(?is)^<(?:script|style|title)\b[^>]*>.*</(?:script|style|title)\s*>$') THEN regexp_replace(regexp_replace(t, '(?is)^<[a-z]+[^>]*>', ''), '(?is)</[a-z]+\s*>$', '')
        WHEN regexp_matches(t, '{BLOCK_SQL}') THEN ' ' WHEN starts_with(t, '<') AND ends_with(t, '>') THEN '' ELSE t END), '') AS raw FROM t)
SELECT page_id, md5(trim(regexp_replace({UNESCAPE.format('raw')}, '\s+', ' ', 'g'))) AS digest FROM x""")(
    lambda c: c.pages.select("page_id", F.md5(markup.html_to_text(F.col("html"))).alias("digest")))


def sanitized_counts(c: Catalog) -> DataFrame:
    """What is left of each page: allowed elements, safe links, and no trace of scripts, styles or divs."""
    safe = markup.sanitize_html(c.pages, "page_id", "html")
    n = lambda p: F.regexp_count("safe_html", F.lit(p)).cast("long")
    return safe.select("page_id", n("<li>").alias("items"), n("<b>").alias("bold"), n("<br>").alias("breaks"), n("<p>").alias("paragraphs"),
                       n('<a href="').alias("links"), n("<(?:script|style|div|h1|nav|title)").alias("unsafe"))


query("sanitize_html", r"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<li>')) AS items, len(regexp_extract_all(html, '(?i)<b>')) AS bold, len(regexp_extract_all(html, '(?i)<br>')) AS breaks,
       len(regexp_extract_all(html, '(?i)<p>')) AS paragraphs, len(regexp_extract_all(html, '(?i)<a href="(?:https?://|mailto:)')) AS links, CAST(0 AS BIGINT) AS unsafe FROM {pages}""")(sanitized_counts)
query("estimate_pages_html")(lambda c: markup.estimate_pages_html(c.pages, "page_id", "html"))

# Generated meta tags and comments in front of every page.
HEAD = """concat('<META name="DC:creator" content="Ann ', page_id, ' &amp; Bob"><meta property=description content=''About ', page_id, '''><meta name="dc.identifier.doi" content="10.1/', page_id,
 '"><meta name=isbn content="978', page_id, '"><meta name="language" content="eng"><meta name="series" content="S', page_id % 7, '"><meta name="series_index" content="', page_id % 4, '.5"><meta name="tags" content="a, b', page_id,
 '"><meta name="date" content="May ', 1900 + page_id % 100, '">', CASE WHEN page_id % 3 = 0 THEN concat('<!-- AUTHOR="Cid ', page_id, '" TITLE=''Note ', page_id, ''' -->') ELSE '' END, html)"""
query("html_metadata", rf"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Note ' || CAST(page_id AS VARCHAR) ELSE title END AS title, CASE WHEN page_id % 3 = 0 THEN 'Cid ' || CAST(page_id AS VARCHAR) ELSE 'Ann ' || CAST(page_id AS VARCHAR) || '; Bob' END AS authors,
       '' AS publisher, 'en' AS language, 'About ' || CAST(page_id AS VARCHAR) AS description, CAST(1900 + page_id % 100 AS VARCHAR) || '-05' AS date, 'S' || CAST(page_id % 7 AS VARCHAR) AS series,
       CAST(page_id % 4 AS DOUBLE) + 0.5 AS series_index, 'a, b' || CAST(page_id AS VARCHAR) AS tags, 'isbn:978' || CAST(page_id AS VARCHAR) || ', doi:10.1/' || CAST(page_id AS VARCHAR) AS identifiers
FROM (SELECT page_id, trim({UNESCAPE.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}) AS title FROM {{pages}}) x""")(
    lambda c: corpus.html_metadata(c.pages.withColumn("html", F.expr(HEAD)), "page_id", "html"))
query("markdown_metadata", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'T ' || CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 4 IN (2, 3) THEN '' ELSE 'Ann; Bob ' || CAST(doc_id AS VARCHAR) END AS authors,
       CASE WHEN doc_id % 4 IN (2, 3) THEN '' ELSE CAST(1900 + doc_id % 100 AS VARCHAR) END AS date, CASE WHEN doc_id % 4 = 0 THEN lang ELSE '' END AS language FROM {documents}""")(
    lambda c: c.documents.select("doc_id", prose.markdown_metadata(F.concat(F.expr("""CASE doc_id % 4
      WHEN 0 THEN concat('\\n# Title: T ', doc_id, '\\r\\n## AUTHOR : Ann & Bob ', doc_id, '\\n\\n### Year: ', 1900 + doc_id % 100, '\\n# lang: ', lang, '\\n')
      WHEN 1 THEN concat('# Title: T ', doc_id, '\\n# Authors: Ann; Bob ', doc_id, '\\n# Date: ', 1900 + doc_id % 100, '\\nplain\\n# lang: fr\\n')
      WHEN 2 THEN concat('# Title: T ', doc_id, '\\n# Chapter 1\\n# Author: X\\n') ELSE 'No heading\\n# Title: X\\n' END"""), "text")).alias("m")).select("doc_id", "m.*"))
