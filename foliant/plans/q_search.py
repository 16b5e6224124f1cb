"""Full-text search, saved searches and visibility, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.ordering import page
from foliant.functions.tokens import ACCENTED, PLAIN
from foliant.operators import browse, scope, search, segments
from foliant.plans.bindings import ORACLE_ONLY
from foliant.plans.registry import query
from foliant.session import ensure_checkpoint_dir, version_of
from foliant.sources.catalog import Catalog


def build_index(c: Catalog) -> search.SearchIndex:
    return search.build_search_index(c.books, c.authors, c.book_authors, c.tags, c.book_tags, c.assets)


def store_of(c: Catalog) -> segments.IndexStore:
    """The store of the catalogue's index in the shared folder, one for each state of the tables."""
    name = version_of([c.part, c.lineitem, c.supplier, c.region, c.nation])
    return segments.IndexStore(c.spark, f"{ensure_checkpoint_dir(c.spark)}/search-{search.FORMAT}-{name}")


def index_of(c: Catalog) -> search.SearchIndex:
    return store_of(c).create(lambda: build_index(c))


def document_index(c: Catalog) -> search.SearchIndex:
    """The provided documents as one long field each."""
    pieces = c.documents.select(F.col("doc_id").alias("book_id"), F.lit("description").alias("field"),
                                F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("tie"), "text")
    return search.index_values(pieces)


def words_sql(expr: str) -> str:
    return (f"regexp_extract_all(translate(regexp_replace(lower({expr}), '[̀-̱]', '', 'g'), "
            f"'{ACCENTED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Co}}}}]+')")


ORACLE_ONLY["pieces"] = """
SELECT id AS book_id, 'title' AS field, 0 AS place, 0 AS tie, title AS txt FROM {books}
UNION ALL SELECT id, 'series', 0, 0, series FROM {books} WHERE series IS NOT NULL
UNION ALL SELECT id, 'description', 0, 0, description FROM {books} WHERE description IS NOT NULL
UNION ALL SELECT id, 'identifiers', 0, 0, identifiers FROM {books} WHERE identifiers IS NOT NULL
UNION ALL SELECT ba.book_id, 'authors', ba.author_order, ba.author_id, a.name FROM {book_authors} ba JOIN {authors} a ON a.id = ba.author_id
UNION ALL SELECT bt.book_id, t.kind || 's', bt.position, bt.tag_id, t.name FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id
UNION ALL SELECT book_id, 'filename', id, 0, filename FROM {assets}"""
ORACLE_ONLY["placed"] = f"""
SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY book_id, field ORDER BY place, tie
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_pos
FROM (SELECT book_id, field, place, tie, {words_sql('txt')} AS words FROM {{pieces}}) w"""
ORACLE_ONLY["tag_tokens"] = """
SELECT DISTINCT bt.book_id, substr(t.kind, 1, 1) || sha256(t.name_key) AS term
FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id
UNION ALL
SELECT DISTINCT bt.book_id, 'b' || substr(t.kind, 1, 1) || sha256(a.name_key)
FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id JOIN {tags} a ON a.kind = t.kind AND starts_with(t.name_key, a.name_key || '.')"""
ORACLE_ONLY["post"] = """
SELECT book_id, field, term, CAST(first_pos + i - 1 AS BIGINT) AS pos
FROM (SELECT book_id, field, first_pos, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM {placed}) u
UNION ALL SELECT book_id, 'tag_keys', term, 0 FROM {tag_tokens}"""
ORACLE_ONLY["doc_lengths"] = "SELECT book_id, CAST(count(*) AS BIGINT) AS length FROM {post} GROUP BY book_id"
WEIGHT = ("CASE field WHEN 'title' THEN 10.0 WHEN 'authors' THEN 8.0 WHEN 'series' THEN 4.0 "
          "WHEN 'tag_keys' THEN 0.0 ELSE 1.0 END")


def clause_sql(number: int, words: list[str], prefix: bool, field: str | None = None, source: str = "post") -> str:
    """Weighted phrase occurrences per book, as self-joined postings."""
    parts = [f"{{{source}}} w0"] + [
        f"JOIN {{{source}}} w{i} ON w{i}.book_id = w0.book_id AND w{i}.field = w0.field AND w{i}.pos = w0.pos + {i}"
        for i in range(1, len(words))]
    where = [f"starts_with(w{i}.term, '{w}')" if prefix and i == len(words) - 1 else f"w{i}.term = '{w}'"
             for i, w in enumerate(words)]
    where.append(f"w0.field = '{field}'" if field else "w0.field <> 'tag_keys'")
    return (f"SELECT {number} AS clause, w0.book_id, sum({WEIGHT.replace('field', 'w0.field')}) AS freq FROM {' '.join(parts)} "
            f"WHERE {' AND '.join(where)} GROUP BY w0.book_id")


def ranked_sql(clauses: list[str], lengths: str = "doc_lengths") -> str:
    return f"""
hits AS ({' UNION ALL '.join(clauses)}),
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM {{{lengths}}}),
found AS (SELECT clause, count(*) AS nhit FROM hits GROUP BY clause),
scored AS (
  SELECT h.book_id, count(*) AS got,
         round(-sum(greatest(ln((c.n - f.nhit + 0.5) / (f.nhit + 0.5)), 1e-6) * (h.freq * 2.2)
                    / (h.freq + 1.2 * (0.25 + 0.75 * l.length / c.mean))), 6) AS score
  FROM hits h JOIN found f ON f.clause = h.clause JOIN {{{lengths}}} l ON l.book_id = h.book_id, corpus c
  GROUP BY h.book_id HAVING count(*) = {len(clauses)})"""


query("search_index_postings", """
SELECT field, term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, count(DISTINCT book_id) AS n_books FROM {post} GROUP BY field, term""")(
    lambda c: index_of(c).postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.count_distinct("book_id").alias("n_books")))
query("search_index_lengths", "SELECT book_id, length FROM {doc_lengths}")(lambda c: index_of(c).lengths)
FIELD_COUNTS = """
SELECT field, count(*) AS n, count(DISTINCT term) AS n_terms, count(DISTINCT book_id) AS n_books, CAST(sum(pos) AS BIGINT) AS pos_sum FROM {post} GROUP BY field"""


def built_anew(c: Catalog) -> DataFrame:
    """The index built and written whether or not the store has one; a store without a version takes it as its first."""
    store = store_of(c)
    made = store.stage(build_index(c), None, 1)
    if not store.versions():
        store.commit([made], 0)
    return store.view([made]).postings.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("n_terms"), F.count_distinct("book_id").alias("n_books"),
        F.sum("pos").alias("pos_sum"))


query("build_search_index", FIELD_COUNTS)(built_anew)

# One book in a hundred is edited: every third of them is deleted for good, the others get a longer title and lose their tags.
EDITED, DELETED = "id % 100 = 0", "id % 300 = 0"


def edited(c: Catalog) -> Catalog:
    gone = c.books.where(DELETED).select(F.col("id").alias("book_id"))
    changed = c.books.where(EDITED).select(F.col("id").alias("book_id"))
    return Catalog.of(
        c.spark, authors=c.authors, tags=c.tags,
        books=c.books.where(f"NOT ({DELETED})").withColumn("title", F.expr(f"CASE WHEN {EDITED} THEN concat(title, ' Édition revised') ELSE title END")),
        book_authors=c.book_authors.join(gone, "book_id", "left_anti"), assets=c.assets.join(gone, "book_id", "left_anti"),
        book_tags=c.book_tags.join(changed, "book_id", "left_anti"))


def index_after_edits(c: Catalog) -> search.SearchIndex:
    """The stored index with a segment for the edited books only; the store's versions stay as they are."""
    store, after = store_of(c), edited(c)
    store.create(lambda: build_index(c))
    changed = c.books.where(EDITED).select(F.col("id").alias("book_id"))
    return store.view(store.staged_update(changed, lambda ids: segments.build_for(ids, after)))


ORACLE_ONLY["post_edited"] = """
SELECT book_id, field, term, pos FROM {post} WHERE book_id % 100 <> 0 OR (book_id % 300 <> 0 AND field NOT IN ('genres', 'tags', 'tag_keys'))
UNION ALL
SELECT book_id, field, w.term, CAST(first_pos + len(words) + w.i AS BIGINT) FROM {placed}, (VALUES ('edition', 0), ('revised', 1)) AS w(term, i)
WHERE field = 'title' AND book_id % 100 = 0 AND book_id % 300 <> 0"""
ORACLE_ONLY["edited_lengths"] = "SELECT book_id, CAST(count(*) AS BIGINT) AS length FROM {post_edited} GROUP BY book_id"
query("index_segment_postings", """
SELECT field, term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, count(DISTINCT book_id) AS n_books FROM {post_edited} GROUP BY field, term""")(
    lambda c: index_after_edits(c).postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.count_distinct("book_id").alias("n_books")))
query("index_segment_lengths", "SELECT book_id, length FROM {edited_lengths}")(lambda c: index_after_edits(c).lengths)
query("tag_search_keys", "SELECT book_id, term FROM {tag_tokens}")(lambda c: search.tag_search_keys(c.tags, c.book_tags))


def hit_list(hits: DataFrame, limit: int = 200) -> DataFrame:
    return page(hits, browse.list_keys("relevance"), limit).select("rn", "id", "title", "score")


def ranked_query(name: str, q: str, clauses: list[str], extra: str = "", user_id: int = 0) -> None:
    query(name, f"""
WITH {ranked_sql(clauses)}
SELECT CAST(row_number() OVER (ORDER BY s.score, b.id) AS BIGINT) AS rn, b.id, b.title, s.score
FROM scored s JOIN {{books}} b ON b.id = s.book_id WHERE b.deleted_at IS NULL {extra} QUALIFY rn <= 200""")(
        lambda c: hit_list(search.search(c, index_of(c), q, user_id)))


ASIA = "t.name_key = 'asia' OR starts_with(t.name_key, 'asia.')"
IN_ASIA = f"b.id IN (SELECT bt.book_id FROM {{book_tags}} bt JOIN {{tags}} t ON t.id = bt.tag_id WHERE t.kind = 'genre' AND ({ASIA}))"
ranked_query("search_terms_and", "red author:moreau widg",
             [clause_sql(0, ["red"], False), clause_sql(1, ["moreau"], True, "authors"), clause_sql(2, ["widg"], True)])
ranked_query("search_prefix_last", "b series:brand#1", [clause_sql(0, ["b"], True), clause_sql(1, ["brand", "1"], True, "series")])
ranked_query("search_phrase", '"hot gear"', [clause_sql(0, ["hot", "gear"], False)])
ranked_query("search_phrase_accents", 'author:"Élodie Moreau" small',
             [clause_sql(0, ["elodie", "moreau"], False, "authors"), clause_sql(1, ["small"], True)])
ranked_query("search_tag_branch", 'genre:"Asia" bolt', [clause_sql(0, ["bolt"], True)], f"AND {IN_ASIA}")
ranked_query("search_tag_exact", 'genre:="asia" widget', [clause_sql(0, ["widget"], True)],
             "AND b.id IN (SELECT bt.book_id FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id WHERE t.kind = 'genre' AND t.name_key = 'asia')")
ranked_query("search_missing_description", "no:description ring", [clause_sql(0, ["ring"], True)],
             "AND (b.description IS NULL OR b.description = '')")
ranked_query("search_status", "status:reading gear", [clause_sql(0, ["gear"], True)],
             "AND b.id IN (SELECT book_id FROM {reading_state} WHERE user_id = 5 AND status = 'reading')", 5)



def search_after_edits(c: Catalog) -> DataFrame:
    index, after = index_after_edits(c), edited(c)
    terms = search.parse_query("title:edition revi")
    hits = search.rank_bm25(index, search.match_terms(index, terms), len(terms)).withColumnRenamed("book_id", "id")
    return hit_list(browse.live(after.books).join(hits, "id"))


query("search_after_edits", f"""
WITH {ranked_sql([clause_sql(0, ["edition"], True, "title", "post_edited"), clause_sql(1, ["revi"], True, source="post_edited")], "edited_lengths")}
SELECT CAST(row_number() OVER (ORDER BY s.score, b.id) AS BIGINT) AS rn, b.id, b.title || ' Édition revised' AS title, s.score
FROM scored s JOIN {{books}} b ON b.id = s.book_id WHERE b.deleted_at IS NULL QUALIFY rn <= 200""")(search_after_edits)

for _what, _cond in {
    "cover": "b.cover_version <= 0",
    "genres": "b.id NOT IN (SELECT bt.book_id FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id WHERE t.kind = 'genre')",
    "tags": "b.id NOT IN (SELECT bt.book_id FROM {book_tags} bt JOIN {tags} t ON t.id = bt.tag_id WHERE t.kind = 'tag')",
    "description": "b.description IS NULL OR b.description = ''",
    "author": "b.id NOT IN (SELECT book_id FROM {book_authors})",
    "series": "b.series IS NULL OR trim(b.series) = ''",
}.items():
    query(f"search_no_{_what}", f"SELECT b.id FROM {{books}} b WHERE b.deleted_at IS NULL AND ({_cond})")(
        lambda c, w=_what: search.missing(browse.live(c.books), w, c.book_authors, c.tags, c.book_tags).select("id"))
query("search_status_unread", """
SELECT b.id FROM {books} b LEFT JOIN {reading_state} s ON s.book_id = b.id AND s.user_id = 5
WHERE b.deleted_at IS NULL AND coalesce(s.status, 'unread') = 'unread'""")(
    lambda c: search.with_status(browse.live(c.books), c.reading_state, 5, "unread").select("id"))
query("count_search", f"""
WITH {ranked_sql([clause_sql(0, ["red"], True)])}
SELECT count(*) AS n FROM scored s JOIN {{books}} b ON b.id = s.book_id WHERE b.deleted_at IS NULL AND b.id IN (SELECT book_id FROM {{assets}})""")(
    lambda c: search.count_search(c, index_of(c), "red"))

ORACLE_ONLY["doc_words"] = f"""
SELECT doc_id AS book_id, 'description' AS field, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos
FROM (SELECT doc_id, {words_sql('text')} AS words FROM {{documents}}) w"""
ORACLE_ONLY["doc_sizes"] = "SELECT book_id, CAST(count(*) AS BIGINT) AS length FROM {doc_words} GROUP BY book_id"


def search_documents(c: Catalog) -> DataFrame:
    index = document_index(c)
    clauses = search.parse_query('"in the" wh')
    scores = search.rank_bm25(index, search.match_terms(index, clauses), len(clauses))
    return page(scores.withColumnRenamed("book_id", "id"), browse.list_keys("relevance"), 500)


query("search_documents", f"""
WITH {ranked_sql([clause_sql(0, ["in", "the"], False, source="doc_words"), clause_sql(1, ["wh"], True, source="doc_words")], "doc_sizes")}
SELECT CAST(row_number() OVER (ORDER BY score, book_id) AS BIGINT) AS rn, book_id AS id, score FROM scored QUALIFY rn <= 500""")(search_documents)

# --- saved searches ------------------------------------------------------------------
ORACLE_ONLY["saved_tokens"] = r"""
SELECT id AS shelf_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
FROM (SELECT id, regexp_extract_all(query, '(?:"(?:[^"]|"")*"?|[^\s"])+') AS toks FROM {query_shelves}) t"""
ORACLE_ONLY["saved_read"] = r"""
SELECT shelf_id, pos, token, key, exact, closed, contains(token, '"') AND closed AS quoted,
       replace(replace(replace(rest, '""', chr(1)), '"', ''), chr(1), '"') AS value
FROM (SELECT *, regexp_extract(token, '^(author|series|tag|genre|title|no|status):', 1) AS key,
             regexp_matches(token, '^(tag|genre):=') AS exact,
             regexp_matches(token, '^(?:"(?:[^"]|"")*"|[^\s"])+$') AS closed,
             regexp_replace(token, '^(?:(?:tag|genre):=|(?:author|series|tag|genre|title|no|status):)', '') AS rest
      FROM {saved_tokens}) r"""
ORACLE_ONLY["saved_terms"] = """
WITH r AS (SELECT *, (key = 'no' AND lower(value) IN ('cover','genres','tags','description','author','series'))
                     OR (key = 'status' AND lower(value) IN ('unread','reading','finished','dropped')) AS is_filter FROM {saved_read}),
e AS (SELECT *, CASE WHEN NOT closed THEN 'Close the quote' WHEN key <> '' AND value = '' THEN key || ': requires a value'
                     WHEN key = 'no' AND NOT is_filter THEN 'no:' || value || ' is not a supported filter'
                     WHEN key = 'status' AND NOT is_filter THEN 'status:' || value || ' is not a supported status' END AS bad FROM r),
v AS (SELECT shelf_id, coalesce(min_by(bad, pos) FILTER (bad IS NOT NULL),
                                CASE WHEN NOT bool_or(value <> '') THEN 'Search query needs at least one term' END, '') AS error,
             bool_or(is_filter) AS any_filter, max(pos) FILTER (value <> '' AND key = '') AS last_free FROM e GROUP BY shelf_id)
SELECT e.shelf_id, e.pos, e.token, e.key, e.value, e.quoted, e.exact,
       NOT e.quoted AND (e.key <> '' OR e.pos IS NOT DISTINCT FROM v.last_free) AS prefix, e.is_filter, v.error,
       v.error = '' AND NOT v.any_filter AS may_grant_access
FROM e JOIN v ON v.shelf_id = e.shelf_id WHERE e.value <> '' OR e.bad IS NOT NULL"""
query("saved_query_terms", """
SELECT shelf_id, CAST(pos AS BIGINT) AS pos, token, key, value, quoted, exact, prefix, is_filter, error, may_grant_access
FROM {saved_terms}""")(lambda c: search.saved_query_terms(c.shelves))
ORACLE_ONLY["saved_words"] = f"""
SELECT shelf_id, pos, key, len(words) AS n, prefix, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place
FROM (SELECT *, {words_sql('value')} AS words FROM {{saved_terms}}
      WHERE may_grant_access AND NOT (key IN ('tag', 'genre') AND (quoted OR exact))) x"""
ORACLE_ONLY["saved_lookup"] = """
SELECT DISTINCT w.word, w.pre, v.term FROM (SELECT DISTINCT word, prefix AND place = n - 1 AS pre FROM {saved_words}) w
JOIN (SELECT DISTINCT term FROM {post}) v ON CASE WHEN w.pre THEN starts_with(v.term, w.word) ELSE v.term = w.word END"""
ORACLE_ONLY["saved_hits"] = """
WITH filled AS (
  SELECT w.shelf_id, w.pos, w.n, p.book_id, p.field, p.pos - w.place AS first_pos, w.place
  FROM {saved_words} w JOIN {saved_lookup} k ON k.word = w.word AND k.pre = (w.prefix AND w.place = w.n - 1) JOIN {post} p ON p.term = k.term
  WHERE CASE w.key WHEN '' THEN p.field <> 'tag_keys' WHEN 'author' THEN p.field = 'authors' WHEN 'tag' THEN p.field = 'tags'
                   WHEN 'genre' THEN p.field = 'genres' ELSE p.field = w.key END)
SELECT DISTINCT shelf_id, pos, book_id FROM (
  SELECT shelf_id, pos, book_id, field, first_pos FROM filled GROUP BY ALL HAVING count(DISTINCT place) = max(n)) g
UNION
SELECT s.shelf_id, s.pos, bt.book_id FROM {saved_terms} s JOIN {tags} t ON t.kind = s.key
  AND (t.name_key = lower(s.value) OR (NOT s.exact AND starts_with(t.name_key, lower(s.value) || '.')))
JOIN {book_tags} bt ON bt.tag_id = t.id
WHERE s.may_grant_access AND s.key IN ('tag', 'genre') AND (s.quoted OR s.exact)""".replace("GROUP BY ALL", "GROUP BY shelf_id, pos, book_id, field, first_pos")
ORACLE_ONLY["query_matches"] = """
SELECT h.shelf_id, h.book_id FROM {saved_hits} h
JOIN (SELECT shelf_id, count(*) AS need FROM {saved_terms} WHERE may_grant_access GROUP BY shelf_id) n ON n.shelf_id = h.shelf_id
GROUP BY h.shelf_id, h.book_id HAVING count(*) = max(n.need)"""


def matches_of(c: Catalog) -> DataFrame:
    return search.evaluate_saved_queries(index_of(c), c.shelves)


def matches_for(c: Catalog, users: DataFrame) -> DataFrame:
    """The matches of the saved searches that some accounts are assigned to."""
    assigned = scope.scope_shelves(users, c.shelves, c.user_scope_shelves).select(F.col("shelf_id").alias("id"))
    return search.evaluate_saved_queries(index_of(c), c.shelves.join(assigned, "id", "left_semi"))


query("evaluate_saved_queries", "SELECT shelf_id, book_id FROM {query_matches}")(matches_of)

query("rename_in_saved_queries", """
SELECT CAST(shelf_id AS BIGINT) AS shelf_id, query FROM (VALUES (903, 'genre:"Orient"'), (904, 'genre:="Orient" widget'), (909, 'tag:"Rack.SMALL"')) AS x(shelf_id, query)
UNION ALL SELECT c_custkey + 2000, CASE WHEN c_custkey % 6 = 2 THEN 'tag:"Rack.' || p_type || '"' ELSE 'genre:"Orient" ' || p_name END
FROM {customer} JOIN {part} ON p_partkey = c_custkey WHERE c_custkey % 6 IN (2, 5)""")(
    lambda c: search.rename_in_saved_queries(c.shelves, c.tags.where(
        F.expr("(kind = 'genre' AND startswith(name_key, 'asia')) OR (kind = 'tag' AND startswith(name_key, 'shelf.'))")).select(
        "kind", "name_key", F.expr("CASE WHEN kind = 'genre' THEN concat('Orient', substr(name, 5)) ELSE concat('Rack', substr(name, 6)) END").alias("new_name"))))

# --- visibility ----------------------------------------------------------------------
ORACLE_ONLY["visible_all"] = """
SELECT DISTINCT g.user_id, x.book_id FROM {user_scope_shelves} g
JOIN {users} u ON u.id = g.user_id AND u.role = 'reader' AND u.content_scope = 'shelves'
JOIN {shelves} s ON s.id = g.shelf_id AND (s.visibility = 'shared' OR s.owner_id <> g.user_id)
JOIN (SELECT shelf_id, book_id FROM {shelf_books} UNION ALL SELECT shelf_id, book_id FROM {query_matches}) x ON x.shelf_id = s.id"""


def grants(c: Catalog) -> DataFrame:
    return scope.scope_shelves(c.users, c.shelves, c.user_scope_shelves)


def visible_all(c: Catalog) -> DataFrame:
    return scope.visible_books_all(c.users, c.shelves, c.user_scope_shelves, c.shelf_books, matches_for(c, c.users))


query("visible_books_all", "SELECT user_id, book_id FROM {visible_all}")(visible_all)
for _name, _user in (("scoped", 19), ("full", 8)):
    query(f"visible_books_{_name}", f"""
SELECT book_id FROM {{visible_all}} WHERE user_id = {_user}
UNION ALL SELECT b.id FROM {{books}} b, {{users}} u WHERE u.id = {_user} AND NOT (u.role = 'reader' AND u.content_scope = 'shelves')""")(
        lambda c, u=_user: scope.visible_books(u, c.users, c.shelves, c.user_scope_shelves, c.shelf_books, matches_for(c, c.users.where(F.col("id") == u)), c.books))

REQUESTS = """
SELECT u AS user_id, kind, target_id FROM (
  SELECT o_custkey + 1 AS u, 'live' AS kind, o_orderkey % (SELECT count(*) FROM {part}) + 1 AS target_id FROM {orders}
  UNION ALL SELECT o_custkey + 1, 'trashed', (o_orderkey % (SELECT CAST(floor(count(*) / 17) AS BIGINT) + 3 FROM {part})) * 17 + 1 FROM {orders}
  UNION ALL SELECT o.o_custkey + 1, 'asset', (l.l_partkey + 1) * 10000000000 + l.l_suppkey + 1 FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey) q
GROUP BY u, kind, target_id"""
ORACLE_ONLY["access_requests"] = REQUESTS
from foliant.plans.bindings import BINDINGS  # noqa: E402  (the request table is bound for both engines)

BINDINGS["access_requests"] = ORACLE_ONLY.pop("access_requests")
query("can_access", """
SELECT r.user_id, r.kind, r.target_id,
       coalesce((b.deleted_at IS NOT NULL) = (r.kind = 'trashed') AND u.id IS NOT NULL
                AND (NOT (u.role = 'reader' AND u.content_scope = 'shelves') OR v.book_id IS NOT NULL), false) AS allowed
FROM {access_requests} r LEFT JOIN {assets} a ON r.kind = 'asset' AND a.id = r.target_id
LEFT JOIN {books} b ON b.id = CASE WHEN r.kind = 'asset' THEN a.book_id ELSE r.target_id END
LEFT JOIN {users} u ON u.id = r.user_id LEFT JOIN {visible_all} v ON v.user_id = r.user_id AND v.book_id = b.id""")(
    lambda c: scope.can_access(c.access_requests, c.users, grants(c), c.shelf_books, lambda shelves, books: search.evaluate_saved_queries(
        index_of(c).within(books), c.shelves.join(shelves.withColumnRenamed("shelf_id", "id"), "id", "left_semi")), c.books, c.assets))


def search_ranked(c: Catalog) -> DataFrame:
    """The flagship: search, rank and page within one scoped reader's visible books."""
    seen = scope.visible_books(19, c.users, c.shelves, c.user_scope_shelves, c.shelf_books, matches_for(c, c.users.where(F.col("id") == 19)), c.books)
    return hit_list(search.search(c, index_of(c), "gear author:moreau", 19, seen), 100)


query("search_ranked", f"""
WITH {ranked_sql([clause_sql(0, ["gear"], True), clause_sql(1, ["moreau"], True, "authors")])}
SELECT CAST(row_number() OVER (ORDER BY s.score, b.id) AS BIGINT) AS rn, b.id, b.title, s.score
FROM scored s JOIN {{books}} b ON b.id = s.book_id WHERE b.deleted_at IS NULL
  AND b.id IN (SELECT book_id FROM {{visible_all}} WHERE user_id = 19) QUALIFY rn <= 100""")(search_ranked)
