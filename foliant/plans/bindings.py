"""Logical tables bound onto the provided parquet tables.

Each binding is one portable SQL text, used as a DataFrame by Spark and as a
common table expression by the SQL oracle. ``{name}`` refers to a base table or
to another binding; ``@EPOCH``, ``@MILLIS`` and ``@ROW`` stand for the few
functions the two engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from foliant.session import spread
from foliant.sources.catalog import Catalog

# Declared, so that opening a table costs no schema-inference job.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
BASE = tuple(BASE_SCHEMAS)

_SPARK = {"@EPOCH(": "unix_timestamp(", "@ROW(": "struct("}
_DUCK = {"@EPOCH(": "epoch_s(", "@MILLIS(": "epoch_m(", "@ROW(": "row("}

BINDINGS: dict[str, str] = {}

# The grouped right side is unique per book, so the join disappears from every
# plan that does not read primary_author_sort.
BINDINGS["books"] = """
SELECT p.p_partkey + 1 AS id, p.p_name AS title,
       CASE WHEN p.p_partkey % 4 = 0 THEN upper(p.p_name) ELSE p.p_name END AS sort_title,
       coalesce(f.sort_name, '') AS primary_author_sort,
       CASE WHEN p.p_partkey % 7 <> 0 THEN p.p_brand END AS series,
       CASE WHEN p.p_partkey % 5 <> 0 THEN CAST(p.p_size % 10 AS DOUBLE) END AS series_index,
       CASE WHEN p.p_partkey % 3 <> 0 THEN p.p_type || ' ' || p.p_name END AS description,
       CASE WHEN p.p_partkey % 4 <> 1 THEN 'House ' || CAST(p.p_size AS STRING) END AS publisher,
       CASE p.p_partkey % 4 WHEN 0 THEN CAST(1950 + p.p_partkey % 70 AS STRING)
            WHEN 1 THEN CAST(1950 + p.p_partkey % 70 AS STRING) || '-0' || CAST(1 + p.p_partkey % 9 AS STRING)
            WHEN 2 THEN CAST(1950 + p.p_partkey % 70 AS STRING) || '-1' || CAST(p.p_partkey % 3 AS STRING) || '-15' END AS published_date,
       CASE p.p_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de-AT' WHEN 3 THEN 'es' END AS language,
       CASE WHEN p.p_partkey % 6 <> 0 THEN 'isbn:' || CAST(9780000000000 + p.p_partkey AS STRING) END AS identifiers,
       CASE WHEN p.p_partkey % 9 = 0 THEN '{{"title":true}}' END AS manual_overrides,
       p.p_partkey % 5 AS metadata_rev, p.p_partkey % 4 AS cover_version,
       p.p_partkey * 60 + 100 AS created_at, p.p_partkey * 60 + 200 AS updated_at,
       CAST(floor(p.p_partkey / 3) AS BIGINT) * 180 AS added_at,
       CASE WHEN p.p_partkey % 17 = 0 THEN p.p_partkey * 60 + 900 END AS deleted_at,
       CASE WHEN p.p_partkey % 34 = 0 THEN p.p_partkey % 1500 + 1 END AS deleted_by
FROM {part} p LEFT JOIN (SELECT book_id, max(sort_name) AS sort_name FROM {first_author} GROUP BY book_id) f
  ON f.book_id = p.p_partkey + 1
"""

# Every book has authors in lineitem; one book in 23 is left without for no:author.
BINDINGS["book_authors"] = """
SELECT l_partkey + 1 AS book_id, l_suppkey + 1 AS author_id, 'aut' AS role,
       min(l_orderkey) AS author_order
FROM {lineitem} WHERE l_partkey % 23 <> 0 GROUP BY l_partkey, l_suppkey
"""

BINDINGS["authors"] = """
SELECT s_suppkey + 1 AS id,
       CASE s_suppkey % 6 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Boris' WHEN 2 THEN 'Chloé' WHEN 3 THEN 'Dmitri'
            WHEN 4 THEN 'Élodie' ELSE 'Farid' END || ' ' ||
       CASE s_suppkey % 5 WHEN 0 THEN 'Moreau' WHEN 1 THEN 'novak' WHEN 2 THEN 'Okafor' WHEN 3 THEN 'Petrov'
            ELSE 'Quist' END || ' ' || CAST(s_suppkey AS STRING) AS name,
       CASE s_suppkey % 5 WHEN 0 THEN 'Moreau' WHEN 1 THEN 'novak' WHEN 2 THEN 'Okafor' WHEN 3 THEN 'Petrov'
            ELSE 'Quist' END || ' ' || CAST(s_suppkey AS STRING) || ', ' ||
       CASE s_suppkey % 6 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Boris' WHEN 2 THEN 'Chloé' WHEN 3 THEN 'Dmitri'
            WHEN 4 THEN 'Élodie' ELSE 'Farid' END AS sort_name
FROM {supplier}
"""

BINDINGS["first_author"] = """
SELECT f.book_id, a.name, a.sort_name
FROM (SELECT book_id, min_by(author_id, @ROW(author_order, author_id)) AS author_id
      FROM {book_authors} GROUP BY book_id) f
JOIN {authors} a ON a.id = f.author_id
"""

BINDINGS["asset_pairs"] = """
SELECT l_partkey, l_suppkey, min(l_returnflag || l_linestatus) AS flags,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       min(@EPOCH(l_shipdate)) AS first_s, max(@EPOCH(l_shipdate)) AS last_s
FROM {lineitem} GROUP BY l_partkey, l_suppkey
"""

BINDINGS["assets"] = """
SELECT (p.l_partkey + 1) * 10000000000 + p.l_suppkey + 1 AS id, p.l_partkey + 1 AS book_id,
       CASE WHEN p.l_suppkey % 3 = 0 THEN 1 + p.cents % 500 END AS page_count,
       'b/' || CAST(p.l_partkey AS STRING) || '/' || CAST(p.l_suppkey AS STRING) || '.' || f.fmt AS storage_path,
       CAST(p.l_suppkey AS STRING) || '.' || f.fmt AS filename,
       'Book ' || CAST(p.l_partkey AS STRING) || '.' || f.fmt AS original_filename,
       '.' || f.fmt AS extension, f.fmt AS format,
       p.l_suppkey = m.lead AS is_primary,
       md5(CAST(p.l_partkey AS STRING) || ':' || CAST(p.l_suppkey AS STRING)) AS original_hash,
       md5(CAST(p.l_partkey AS STRING) || ':' || CAST(p.l_suppkey AS STRING)
           || CASE WHEN p.l_suppkey % 3 = 0 THEN ':w' ELSE '' END) AS current_hash,
       p.cents AS original_size,
       CASE WHEN p.l_suppkey % 4 <> 0 THEN p.cents + p.l_suppkey % 3 END AS current_size,
       CASE WHEN p.l_suppkey % 2 = 0 THEN md5(CAST(p.l_partkey % 50 AS STRING) || '/' || CAST(p.l_suppkey AS STRING)) END AS sampled_hash,
       CASE WHEN f.fmt IN ('epub', 'fb2', 'kepub') THEN p.l_suppkey % 4 ELSE 0 END AS writeback_rev,
       CASE WHEN p.l_suppkey % 11 = 0 THEN 'disk full' END AS writeback_error,
       p.first_s AS created_at, p.last_s AS updated_at
FROM {asset_pairs} p
JOIN (VALUES ('AF', 'epub'), ('AO', 'kepub'), ('NF', 'pdf'), ('NO', 'fb2'), ('RF', 'mobi'), ('RO', 'txt'))
     AS f(flags, fmt) ON f.flags = p.flags
JOIN (SELECT l_partkey, min(l_suppkey) AS lead FROM {lineitem} GROUP BY l_partkey) m ON m.l_partkey = p.l_partkey
"""

BINDINGS["part_kinds"] = """
SELECT kind, CAST(code AS BIGINT) AS code FROM
(VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4), ('SMALL', 5), ('STANDARD', 6)) AS k(kind, code)
"""

BINDINGS["tags"] = """
SELECT CAST(1000 + r_regionkey AS BIGINT) AS id, r_name AS name, lower(r_name) AS name_key, 'genre' AS kind, CAST(NULL AS BIGINT) AS parent_id
FROM {region}
UNION ALL
SELECT CAST(2000 + n.n_nationkey AS BIGINT), r.r_name || '.' || n.n_name, lower(r.r_name || '.' || n.n_name), 'genre', CAST(1000 + r.r_regionkey AS BIGINT)
FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey
UNION ALL
SELECT CAST(3000 AS BIGINT), 'Shelf', 'shelf', 'tag', CAST(NULL AS BIGINT)
UNION ALL
SELECT 3000 + code, 'Shelf.' || kind, lower('Shelf.' || kind), 'tag', CAST(3000 AS BIGINT) FROM {part_kinds}
UNION ALL
SELECT DISTINCT 4000 + k.code * 100 + p.p_size, 'Shelf.' || k.kind || '.Size ' || CAST(p.p_size AS STRING),
       lower('Shelf.' || k.kind || '.Size ' || CAST(p.p_size AS STRING)), 'tag', 3000 + k.code
FROM {part} p JOIN {part_kinds} k ON k.kind = p.p_type
"""

BINDINGS["book_tags"] = """
SELECT l.l_partkey + 1 AS book_id, CAST(2000 + s.s_nationkey AS BIGINT) AS tag_id, min(l.l_orderkey) AS position
FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
WHERE l.l_partkey % 11 <> 0 AND l.l_suppkey % 3 = 0
GROUP BY l.l_partkey, s.s_nationkey
UNION ALL
SELECT p_partkey + 1, CAST(1000 + p_size % 5 AS BIGINT), CAST(-1 AS BIGINT) FROM {part} WHERE p_partkey % 5 = 1
UNION ALL
SELECT p.p_partkey + 1, 4000 + k.code * 100 + p.p_size, CAST(0 AS BIGINT)
FROM {part} p JOIN {part_kinds} k ON k.kind = p.p_type WHERE p.p_partkey % 4 <> 0
UNION ALL
SELECT p.p_partkey + 1, 3000 + k.code, CAST(1 AS BIGINT)
FROM {part} p JOIN {part_kinds} k ON k.kind = p.p_type WHERE p.p_partkey % 6 = 2
"""

BINDINGS["users"] = """
SELECT c_custkey + 1 AS id, lower(c_name) AS username,
       CASE WHEN c_custkey % 3 = 0 THEN 'reader' WHEN c_custkey % 10 = 1 THEN 'admin' ELSE 'member' END AS role,
       CASE WHEN c_custkey % 6 = 0 THEN 'shelves' ELSE 'all' END AS content_scope
FROM {customer}
"""

BINDINGS["segments"] = """
SELECT segment, CAST(seg AS BIGINT) AS seg FROM
(VALUES ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('HOUSEHOLD', 3), ('MACHINERY', 4)) AS g(segment, seg)
"""

# Saved searches: one per customer, and a few with every turn of the language.
# The match text is kept only where the search may grant access.
BINDINGS["query_shelves"] = """
SELECT id, name, query, CASE WHEN kind IN (0, 1, 2, 5) THEN query ELSE '' END AS query_match, owner_id, visibility FROM (
  SELECT c.c_custkey + 2000 AS id, 'Saved ' || CAST(c.c_custkey AS STRING) AS name, c.c_custkey % 6 AS kind, c.c_custkey + 1 AS owner_id, 'personal' AS visibility,
         CASE c.c_custkey % 6 WHEN 0 THEN 'title:"' || p.p_name || '"' WHEN 1 THEN 'series:"' || p.p_brand || '" ' || substr(p.p_name, 1, 2)
              WHEN 2 THEN 'tag:"Shelf.' || p.p_type || '"' WHEN 3 THEN 'no:cover ' || p.p_name WHEN 4 THEN '"' || p.p_name
              ELSE 'genre:"Asia" ' || p.p_name END AS query
  FROM {customer} c JOIN {part} p ON p.p_partkey = c.c_custkey) own
UNION ALL
SELECT CAST(id AS BIGINT) AS id, name, query, query_match, CAST(owner_id AS BIGINT) AS owner_id, visibility FROM (VALUES
  (901, 'Red things', 'red', 'red', 2, 'shared'),
  (902, 'One series', 'series:"Brand#7"', 'series:"Brand#7"', 2, 'shared'),
  (903, 'asia branch', 'genre:"ASIA"', 'genre:"ASIA"', 2, 'shared'),
  (904, 'Asia only', 'genre:="asia" widget', 'genre:="asia" widget', 2, 'personal'),
  (905, 'By author', 'author:moreau widg', 'author:moreau widg', 3, 'shared'),
  (906, 'Phrase', '"hot gear"', '"hot gear"', 3, 'personal'),
  (907, 'No text', 'no:description ring', '', 3, 'shared'),
  (908, 'Reading', 'status:reading', '', 3, 'personal'),
  (909, 'Small ones', 'tag:"Shelf.SMALL"', 'tag:"Shelf.SMALL"', 7, 'shared'),
  (910, 'Unclosed', '"red wid', '', 7, 'personal'),
  (911, 'Empty value', 'author: red', '', 7, 'personal'),
  (912, 'Bad filter', 'no:banana gear', '', 7, 'personal'),
  (913, 'Word tag', 'tag:small title:bolt', 'tag:small title:bolt', 7, 'shared'),
  (914, 'Quotes', 'title:"old ""bolt"" x"', 'title:"old ""bolt"" x"', 7, 'personal')
) AS q(id, name, query, query_match, owner_id, visibility)
"""

BINDINGS["shelves"] = """
SELECT CAST(1 + n.n_nationkey * 5 + g.seg AS BIGINT) AS id, n.n_name || ' ' || lower(g.segment) AS name, 'manual' AS kind,
       CAST(NULL AS STRING) AS query, CAST(NULL AS STRING) AS query_match,
       CAST(2 + n.n_nationkey AS BIGINT) AS owner_id,
       CASE WHEN (n.n_nationkey + g.seg) % 3 <> 0 THEN 'shared' ELSE 'personal' END AS visibility,
       CAST(g.seg AS BIGINT) AS position
FROM {nation} n CROSS JOIN {segments} g
UNION ALL
SELECT id, name, 'query', query, query_match, owner_id, visibility, id % 4 FROM {query_shelves}
"""

BINDINGS["shelf_books"] = """
SELECT CAST(1 + c.c_nationkey * 5 + g.seg AS BIGINT) AS shelf_id, l.l_partkey + 1 AS book_id,
       CAST(floor(min(l.l_orderkey) / 10) AS BIGINT) AS position, min(@EPOCH(o.o_orderdate)) AS added_at
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {segments} g ON g.segment = c.c_mktsegment
GROUP BY c.c_nationkey, g.seg, l.l_partkey
"""

BINDINGS["user_scope_shelves"] = """
SELECT c.c_custkey + 1 AS user_id, CAST(1 + c.c_nationkey * 5 + g.seg AS BIGINT) AS shelf_id
FROM {customer} c JOIN {segments} g ON g.segment = c.c_mktsegment WHERE c.c_custkey % 12 <> 0
UNION ALL
SELECT c_custkey + 1, CAST(901 + c_custkey % 14 AS BIGINT) FROM {customer} WHERE c_custkey % 9 = 0
"""

BINDINGS["user_lines"] = """
SELECT o.o_custkey + 1 AS user_id, l.l_partkey + 1 AS book_id,
       (l.l_partkey + 1) * 10000000000 + l.l_suppkey + 1 AS asset_id,
       @EPOCH(l.l_shipdate) AS at_s, l.l_orderkey AS order_id, CAST(l.l_linenumber AS BIGINT) AS line_no,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents, round(l.l_discount * 10, 1) AS progress,
       l.l_returnflag AS flag
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
"""

BINDINGS["reading_positions"] = """
SELECT user_id, asset_id, max_by(progress, @ROW(at_s, order_id, line_no, cents)) AS progress,
       max_by('p' || CAST(cents AS STRING), @ROW(at_s, order_id, line_no, cents)) AS locator,
       count(*) AS revision,
       max_by('urn:dev:' || CAST(line_no AS STRING), @ROW(at_s, order_id, line_no, cents)) AS device_id,
       max(at_s) AS updated_at
FROM {user_lines} GROUP BY user_id, asset_id
"""

BINDINGS["reading_state"] = """
SELECT user_id, book_id,
       CASE max_by(flag, @ROW(at_s, order_id, line_no, cents)) WHEN 'A' THEN 'reading' WHEN 'N' THEN 'finished' ELSE 'dropped' END AS status,
       max(order_id) AS last_event_id, max(at_s) AS updated_at
FROM {user_lines} GROUP BY user_id, book_id
"""

# A denser stream of device writes: few users and assets, many writes each.
BINDINGS["sync_writes"] = """
SELECT o.o_custkey % (SELECT greatest(50, CAST(floor(count(*) / 30) AS BIGINT)) FROM {customer}) + 1 AS user_id,
       l.l_partkey % (SELECT greatest(40, CAST(floor(count(*) / 50) AS BIGINT)) FROM {part}) + 1 AS asset_id,
       (l.l_orderkey * 10 + l.l_linenumber) * 10000000 + CAST(round(l.l_extendedprice * 100) AS BIGINT) % 10000000 AS seq,
       @EPOCH(l.l_shipdate) AS modified_at, @EPOCH(o.o_orderdate) AS arrived_at,
       round(l.l_discount * 10, 1) AS progress,
       'd' || CAST(l.l_linenumber % 3 AS STRING) AS device_id,
       'ch' || CAST(l.l_suppkey % 4 AS STRING) AS address,
       CAST(l.l_quantity AS BIGINT) % 6 AS expected_revision,
       l.l_returnflag = 'R' AND l.l_linenumber = 7 AS is_reset
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
"""

BINDINGS["activity"] = """
SELECT event_id AS id, user_id + 1 AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 + 1 AS book_id,
       CASE event_type WHEN 'signup' THEN 'unread' WHEN 'view' THEN 'reading' WHEN 'click' THEN 'reading'
            WHEN 'purchase' THEN 'finished' ELSE 'dropped' END AS status,
       CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'web_reader' WHEN 2 THEN 'sync' ELSE 'feed' END AS source,
       round(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 99.0, 4) AS progress,
       @EPOCH(ts) AS at_s, @MILLIS(ts) AS at_ms
FROM {events}
"""

BINDINGS["annotations"] = """
SELECT conv_id * 100 + turn AS id, conv_id % (SELECT greatest(150, CAST(floor(count(*) / 10) AS BIGINT)) FROM {customer}) + 1 AS user_id,
       (conv_id % (SELECT count(*) FROM {part}) + 1) * 10000000000 + turn + 1 AS asset_id,
       conv_id % (SELECT count(*) FROM {part}) + 1 AS book_id, role, text AS quote,
       CAST(CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS BIGINT) AS deleted, (conv_id + turn) % 40 AS revision,
       CASE (conv_id + turn) % 7 WHEN 0 THEN 'green' WHEN 1 THEN 'blue' WHEN 2 THEN 'pink' WHEN 3 THEN 'purple' WHEN 4 THEN 'mauve' ELSE 'yellow' END AS color,
       CAST(conv_id * 10 + CAST(floor(turn / 2) AS BIGINT) AS BIGINT) AS created_at
FROM {conversations}
"""

BINDINGS["duplicate_sets"] = """
SELECT b.id, b.added_at, b.title, coalesce(f.name, '') AS author, b.description, b.cover_version,
       lower(b.title) || '|' || lower(coalesce(f.name, '')) AS plain_key
FROM {books} b LEFT JOIN {first_author} f ON f.book_id = b.id
WHERE b.deleted_at IS NULL
"""

# Common table expressions used by oracles alone (name -> SQL text).
ORACLE_ONLY: dict[str, str] = {}

# Inputs of text-heavy functions, plain scans each stored as one file here, and their keys.
TEXT_HEAVY = {"documents": "doc_id", "pages": "page_id", "raw_dates": "id", "raw_names": "id", "catalog_rows": "idx", "volume_rows": "idx"}


def _sql_of(name: str) -> str:
    return ORACLE_ONLY[name] if name in ORACLE_ONLY else BINDINGS[name]


def _rewrite(sql: str, words: dict[str, str]) -> str:
    for token, spelled in words.items():
        sql = sql.replace(token, spelled)
    return sql


def references(sql: str) -> list[str]:
    return [name for name in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))]


def bind(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalogue over the base tables in ``sf_dir`` plus every binding.

    The tables hold zone-less timestamps that mean UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def load(name: str) -> DataFrame:
        if name in BASE:
            return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
        sql = re.sub(r"@MILLIS\(([\w.]+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", BINDINGS[name])
        return spark.sql(_rewrite(sql, _SPARK), **{ref: getattr(catalog, ref) for ref in references(sql)})

    def resolve(name: str) -> DataFrame:
        return spread(load(name), TEXT_HEAVY[name]) if name in TEXT_HEAVY else load(name)

    catalog = Catalog(spark, resolve)
    return catalog


def oracle_text(sql: str) -> str:
    """DuckDB text of ``sql``: the bindings it names become leading CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for ref in references(_sql_of(name)):
            visit(ref)
        ordered.append(name)

    for ref in references(sql):
        visit(ref)

    def duck(text: str) -> str:
        text = _rewrite(text, _DUCK)
        text = re.sub(r"epoch_m\(([\w.]+)\)", r"CAST(floor(epoch_us(\1) / 1000) AS BIGINT)", text)
        text = re.sub(r"epoch_s\(([\w.]+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)
        text = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text)
        return text.replace("{{", "{").replace("}}", "}").strip()

    ctes = [f"{name} AS ({duck(_sql_of(name))})" for name in ordered]
    body = duck(sql)
    if not ctes:
        return body
    match = re.match(r"(?is)with\s+(recursive\s+)?(.*)", body)
    if match:
        return f"WITH {match.group(1) or ''}" + ",\n".join(ctes) + ",\n" + match.group(2)
    return "WITH " + ",\n".join(ctes) + "\n" + body
