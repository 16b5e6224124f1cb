"""Full-text catalogue search: postings, the query mini-language, ranking, saved searches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.tagging import path_prefixes, tag_key
from foliant.functions.text import SPACE, strip
from foliant.functions.tokens import python_tokens, tokens
from foliant.operators.browse import blank, live
from foliant.session import cut_lineage, fine_shuffles, if_small, written

# Relevance weight of each indexed field, and the BM25 constants.
WEIGHTS = {"title": 10.0, "authors": 8.0, "series": 4.0, "genres": 1.0, "tags": 1.0, "description": 1.0,
           "identifiers": 1.0, "filename": 1.0, "tag_keys": 0.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
STATUSES = ("unread", "reading", "finished", "dropped")
MISSING = ("cover", "genres", "tags", "description", "author", "series")
FIELD_OF = {"": "", "author": "authors", "series": "series", "title": "title", "tag": "tags", "genre": "genres"}

QUOTED = r'"(?:[^"]|"")*"?'
TOKEN = rf'(?:{QUOTED}|[^\s"])+'
CLOSED = r'^(?:"(?:[^"]|"")*"|[^\s"])+$'
QUALIFIED = r'^("?)(author|series|tag|genre|title|no|status)\1:'

POSTINGS = "book_id bigint, field string, term string, pos bigint"
LENGTHS = "book_id bigint, length bigint"
FREQUENCIES = "field string, term string, books bigint"
FORMAT = 3  # of a written index and of its words


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(field, term, books): how many books hold a term in a field."""
    return postings.groupBy("field", "term").agg(F.count_distinct("book_id").alias("books"))


def one_row_each(lists: DataFrame) -> DataFrame:
    """Postings (book_id, field, term, pos) of position lists, in the order of the lists."""
    return lists.select("book_id", "field", "term", F.explode("at").alias("pos"))


@dataclass
class SearchIndex:
    """``postings`` (book_id, field, term, pos), ``lengths`` (book_id, length) and, if written, ``frequencies`` (field, term, books).

    With segments not yet merged, ``frequencies`` may count a book more than once: they bound the number of books from above.
    An index just built also has its ``lists`` (book_id, field, term, at), all positions of a term in a field of a book in one row.
    An index limited to some ``books`` (book_id) also has the postings of ``every`` book.
    """

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame | None = None
    lists: DataFrame | None = None
    books: DataFrame | None = None
    every: DataFrame | None = None

    def terms(self) -> DataFrame:
        return term_frequencies(self.postings) if self.frequencies is None else self.frequencies

    def within(self, books: DataFrame) -> "SearchIndex":
        """The same index for lookups of some books (book_id) only; term statistics stay those of all books."""
        some = books.select("book_id").distinct()
        return SearchIndex(self.postings.join(some, "book_id", "left_semi"), self.lengths, self.terms(), books=some, every=self.postings)

    def of_terms(self, named: DataFrame) -> DataFrame:
        """The postings of some terms (term). A limited index picks the terms before the books, so that no other postings are shuffled."""
        held = self.postings if self.books is None else self.every
        found = held.join(if_small(named.select("term").distinct()), "term", "left_semi")
        return found if self.books is None else found.join(self.books, "book_id", "left_semi")

    def write(self, path: str, partitions: int | None = None) -> None:
        """Persist with terms range-partitioned and sorted, so a term lookup prunes files and row groups."""
        parts = (partitions,) if partitions else ()
        rows = self.postings if self.lists is None else self.lists
        placed = rows.repartitionByRange(*parts, "term", "book_id").sortWithinPartitions("term", "book_id")
        if self.lists is not None:
            placed = one_row_each(placed)
        with fine_shuffles(rows.sparkSession, 16):
            placed.write.mode("overwrite").parquet(f"{path}/postings")
        held = self.postings.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
        known = term_frequencies(held) if self.lists is None else self.frequencies
        known.write.mode("overwrite").parquet(f"{path}/frequencies")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str) -> "SearchIndex":
        return cls(*[spark.read.schema(shape).parquet(f"{path}/{name}") for name, shape in (
            ("postings", POSTINGS), ("lengths", LENGTHS), ("frequencies", FREQUENCIES))])


def field_values(books: DataFrame, authors: DataFrame, book_authors: DataFrame, tags: DataFrame,
                 book_tags: DataFrame, assets: DataFrame) -> DataFrame:
    """(book_id, field, at, tie, text): every piece of indexed text in its order inside the field."""
    own = books.select(
        F.col("id").alias("book_id"),
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(f) for f in ("title", "series", "description", "identifiers")]),
            F.array("title", "series", "description", "identifiers"))).alias("field", "text"),
    ).where(F.col("text").isNotNull()).withColumn("at", F.lit(0).cast("long")).withColumn("tie", F.lit(0).cast("long"))
    names = book_authors.join(authors, F.col("author_id") == authors.id).select(
        "book_id", F.lit("authors").alias("field"), F.col("author_order").alias("at"), F.col("author_id").alias("tie"),
        F.col("name").alias("text"))
    labels = book_tags.join(tags, F.col("tag_id") == tags.id).select(
        "book_id", F.concat(F.col("kind"), F.lit("s")).alias("field"), F.col("position").alias("at"),
        F.col("tag_id").alias("tie"), F.col("name").alias("text"))
    files = assets.select("book_id", F.lit("filename").alias("field"), F.col("id").alias("at"),
                          F.lit(0).cast("long").alias("tie"), F.col("filename").alias("text"))
    return own.unionByName(names).unionByName(labels).unionByName(files)


def tag_search_keys(tags: DataFrame, book_tags: DataFrame) -> DataFrame:
    """One token per direct membership and one 'b' token per proper ancestor, each once per book."""
    # Names travel once, before they become several hashes each; the same key of a book then meets in its partition.
    linked = book_tags.join(tags, F.col("tag_id") == tags.id).select("book_id", "kind", "name_key").repartition("book_id")
    paths = path_prefixes(F.col("name_key"))
    token = F.concat(F.substring("kind", 1, 1), F.sha2("path", 256))
    above = F.transform(F.slice(paths, 1, F.size(paths) - 1), lambda path: F.struct(path.alias("path"), F.lit("b").alias("mark")))
    own = F.array(F.struct(F.col("name_key").alias("path"), F.lit("").alias("mark")))
    keys = linked.select("book_id", "kind", F.inline(F.concat(own, F.coalesce(above, F.array().cast("array<struct<path:string,mark:string>>")))))
    return keys.distinct().select("book_id", F.concat("mark", token).alias("term")).distinct()


def build_search_index(books: DataFrame, authors: DataFrame, book_authors: DataFrame, tags: DataFrame,
                       book_tags: DataFrame, assets: DataFrame) -> SearchIndex:
    """Postings over eight text fields and the tag keys, and each book's total token count."""
    return index_values(field_values(books, authors, book_authors, tags, book_tags, assets), tag_search_keys(tags, book_tags))


def index_values(pieces: DataFrame, tag_keys: DataFrame | None = None) -> SearchIndex:
    """Index pieces of text given as (book_id, field, at, tie, text).

    The pieces of a book meet once, as text; places, position lists and word counts are
    made where they meet, by sorts that spill, and written once for what reads them.
    Pieces without a place or a book count for the lengths only.
    """
    before = Window.partitionBy("book_id", "field").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, -1)
    split = pieces.repartition("book_id").withColumn("words", tokens(F.col("text"))).drop("text").withColumn("size", F.size("words").cast("long"))
    placed = split.withColumn("start", F.when(F.col("book_id").isNotNull() & F.col("at").isNotNull(), F.coalesce(F.sum("size").over(before), F.lit(0))))
    text = placed.select("book_id", "field", "start", "size", F.posexplode_outer("words").alias("i", "term")).groupBy("book_id", "field", "term").agg(
        F.collect_list(F.col("start") + F.col("i")).alias("at"),
        F.sum(F.when(F.col("term").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("size"))).alias("n"))
    if tag_keys is not None:
        text = text.unionByName(tag_keys.select(
            "book_id", F.lit("tag_keys").alias("field"), "term", F.array(F.lit(0).cast("long")).alias("at"), F.lit(1).cast("long").alias("n")))
    with fine_shuffles(pieces.sparkSession):
        counted = written(text)
    lists = counted.where(F.size("at") > 0).select("book_id", "field", "term", "at")
    lengths = counted.groupBy("book_id").agg(F.sum("n").alias("length"))
    # A list stands for one book, so no book has to be told apart again.
    frequencies = lists.groupBy("field", "term").agg(F.count("book_id").alias("books"))
    return SearchIndex(one_row_each(lists), lengths, frequencies, lists)


@dataclass
class Term:
    """One AND-ed clause: words adjacent in one field, or a tag selector, or a filter."""

    key: str
    value: str
    quoted: bool
    exact: bool
    prefix: bool = False

    @property
    def is_filter(self) -> bool:
        value = self.value.strip().lower()
        return (self.key == "no" and value in MISSING) or (self.key == "status" and value in STATUSES)

    @property
    def is_selector(self) -> bool:
        return self.key in ("tag", "genre") and (self.quoted or self.exact)

    @property
    def words(self) -> list[str]:
        text = self.value
        if self.key in ("no", "status"):
            text = f"{self.key}:{text}"
        return python_tokens(text)


def parse_query(q: str) -> list[Term]:
    """Lenient reading of the mini-language: free words, quotes, qualifiers, ``=`` for exact tags."""
    terms = []
    for token in re.findall(TOKEN, q.strip()):
        named = re.match(QUALIFIED, token)
        key = named.group(2) if named else ""
        rest = token[named.end():] if named else token
        exact = key in ("tag", "genre") and rest.startswith("=") and not (named and named.group(1))
        rest = rest[1:] if exact else rest
        closed = re.fullmatch(CLOSED.strip("^$"), token) is not None
        value = "".join(
            (p[1:-1] if len(p) > 1 and re.fullmatch(r'"(?:[^"]|"")*"', p) else p[1:]).replace('""', '"') if p[0] == '"' else p
            for p in re.findall(rf'{QUOTED}|[^"]+', rest))
        if value:
            terms.append(Term(key, value, '"' in token and closed, exact, prefix=not ('"' in token and closed)))
    free = [t for t in terms if t.key == "" or (t.key in ("no", "status") and not t.is_filter)]
    for term in free[:-1]:
        term.prefix = False
    return terms


def _matches(term: str, prefix: bool) -> Column:
    return F.col("term").startswith(term) if prefix else F.col("term") == term


def match_terms(index: SearchIndex, terms: list[Term]) -> DataFrame:
    """(book_id, clause, freq): weighted occurrences of every word clause of one query.

    One scan of the postings: rows are filtered by term, tagged with the
    clauses and places they can fill, and a phrase is a group on its start
    position in which every place is filled.
    """
    places = [(c, i, w, term.prefix and i == len(term.words) - 1, FIELD_OF.get(term.key, ""), len(term.words))
              for c, term in enumerate(terms) for i, w in enumerate(term.words)]
    wanted = reduce(lambda a, b: a | b, [_matches(w, p) for _, _, w, p, _, _ in places])
    fills = [
        F.when(_matches(w, p) & (F.col("field") == field if field else F.col("field") != "tag_keys"),
               F.struct(F.lit(c).alias("clause"), F.lit(i).alias("place"), F.lit(n).alias("size")))
        for c, i, w, p, field, n in places
    ]
    weight = F.create_map(*[x for f, w in WEIGHTS.items() for x in (F.lit(f), F.lit(w))])[F.col("field")]
    filled = (
        index.postings.where(wanted)
        .select("book_id", "field", "pos", F.explode(F.filter(F.array(*fills), lambda f: f.isNotNull())).alias("f"))
        .select("book_id", "field", F.col("f.clause").alias("clause"), F.col("f.place").alias("place"),
                F.col("f.size").alias("size"), (F.col("pos") - F.col("f.place")).alias("start"))
    )
    if any(len(t.words) > 1 for t in terms):
        filled = filled.groupBy("book_id", "field", "clause", "start").agg(
            F.count_distinct("place").alias("got"), F.max("size").alias("size")).where("got = size")
    return filled.groupBy("book_id", "clause").agg(F.sum(weight).alias("freq"))


def rank_bm25(index: SearchIndex, hits: DataFrame, n_clauses: int) -> DataFrame:
    """(book_id, score) of books matching every clause; a lower score is better.

    Corpus size, mean length and the clauses' document counts are one-row
    aggregates used as scalar subqueries.
    """
    corpus = index.lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))).scalar()
    found = hits.groupBy("clause").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("clause", "n")))).scalar()
    scored = hits.join(index.lengths, "book_id").withColumn("c", corpus).withColumn("nhit", found[F.col("clause")])
    idf = F.log((F.col("c.n") - F.col("nhit") + 0.5) / (F.col("nhit") + 0.5))
    norm = F.col("freq") + K1 * (1 - B + B * F.col("length") / F.col("c.mean"))
    part = F.greatest(idf, F.lit(LEAST_IDF)) * (F.col("freq") * (K1 + 1)) / norm
    return (
        scored.groupBy("book_id").agg(F.count(F.lit(1)).alias("got"), F.sum(part).alias("s"))
        .where(F.col("got") == n_clauses).select("book_id", F.round(-F.col("s"), 6).alias("score"))
    )


def missing(rows: DataFrame, what: str, book_authors: DataFrame, tags: DataFrame, book_tags: DataFrame) -> DataFrame:
    """Books lacking a cover, genres, tags, a description, an author or a series."""
    if what == "cover":
        return rows.where(F.col("cover_version") <= 0)
    if what == "description":
        return rows.where(F.col("description").isNull() | (F.col("description") == ""))
    if what == "series":
        return rows.where(blank("series"))
    if what == "author":
        return rows.join(book_authors.select(F.col("book_id").alias("id")), "id", "left_anti")
    of_kind = tags.where(F.col("kind") == what[:-1]).select(F.col("id").alias("tag_id"))
    return rows.join(book_tags.join(of_kind, "tag_id", "left_semi").select(F.col("book_id").alias("id")), "id", "left_anti")


def with_status(rows: DataFrame, reading_state: DataFrame, user_id: int, status: str) -> DataFrame:
    """Books in a viewer's status; no reading-state row means unread."""
    mine = reading_state.where(F.col("user_id") == user_id).select(F.col("book_id").alias("id"), F.col("status").alias("_s"))
    return rows.join(mine, "id", "left").where(F.coalesce("_s", F.lit("unread")) == status).drop("_s")


def selected(rows: DataFrame, tags: DataFrame, book_tags: DataFrame, term: Term) -> DataFrame:
    """Books under a quoted tag branch, or directly in an ``=`` tag."""
    key = tag_key(F.lit(term.value))
    nodes = tags.where(F.col("kind") == term.key)
    name = F.col("name_key")
    nodes = nodes.where(name == key) if term.exact else nodes.where(F.array_contains(path_prefixes(name), key))
    linked = book_tags.join(nodes.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return rows.join(linked.select(F.col("book_id").alias("id")), "id", "left_semi")


def search(cat, index: SearchIndex, q: str, user_id: int = 0, visible: DataFrame | None = None) -> DataFrame:
    """Live visible books matching every clause, with a ``score`` (null without words)."""
    terms = parse_query(q)
    rows = live(cat.books, visible)
    for term in terms:
        if term.is_filter and term.key == "no":
            rows = missing(rows, term.value.strip().lower(), cat.book_authors, cat.tags, cat.book_tags)
        elif term.is_filter:
            rows = with_status(rows, cat.reading_state, user_id, term.value.strip().lower())
        elif term.is_selector:
            rows = selected(rows, cat.tags, cat.book_tags, term)
    worded = [t for t in terms if not t.is_filter and not t.is_selector]
    if any(not t.words for t in worded):
        return rows.where(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    if not worded:
        return rows.withColumn("score", F.lit(None).cast("double"))
    # The hits are counted per clause and then scored. A written index is sorted by term, so either pass reads few row groups.
    scores = rank_bm25(index, match_terms(index, worded), len(worded))
    return rows.join(scores.withColumnRenamed("book_id", "id"), "id")


def count_search(cat, index: SearchIndex, q: str, user_id: int = 0, visible: DataFrame | None = None) -> DataFrame:
    """Downloadable hits of a search; an empty query has none."""
    hits = search(cat, index, q, user_id, visible)
    if not parse_query(q):
        hits = hits.where(F.lit(False))
    return hits.join(cat.assets.select(F.col("book_id").alias("id")), "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


# --- saved searches: the same reading of the language, over a column -----------------


def _pieces(text: Column) -> Column:
    """Quoted runs without their quotes and with doubled quotes undone, joined with the plain text."""
    runs = F.regexp_extract_all(text, F.lit(rf'({QUOTED}|[^"]+)'), F.lit(1))
    closed = r'^"(?:[^"]|"")*"$'

    def plain(run: Column) -> Column:
        body = F.when(run.rlike(closed) & (F.length(run) > 1), F.substring(run, 2, F.length(run) - 2)).otherwise(
            F.substring(run, 2, F.length(run)))
        return F.when(run.startswith('"'), F.replace(body, F.lit('""'), F.lit('"'))).otherwise(run)

    return F.array_join(F.transform(runs, lambda r: plain(r)), "")


def _read_token(token: Column) -> dict[str, Column]:
    key = F.regexp_extract(token, QUALIFIED, 2)
    rest = F.regexp_replace(token, QUALIFIED, "")
    exact = key.isin("tag", "genre") & rest.startswith("=") & ~token.startswith('"')
    rest = F.when(exact, F.substring(rest, 2, F.length(rest))).otherwise(rest)
    closed = token.rlike(CLOSED)
    return {"key": key, "value": _pieces(rest), "exact": exact, "closed": closed,
            "quoted": token.contains('"') & closed}


def saved_query_terms(shelves: DataFrame) -> DataFrame:
    """Every stored search as term rows, with the first lint error and the access flag of its shelf."""
    stored = shelves.where(F.col("kind") == "query").select(F.col("id").alias("shelf_id"), strip(F.col("query")).alias("query"))
    split = stored.select("shelf_id", F.posexplode(F.regexp_extract_all("query", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "token"))
    read = split.select("shelf_id", "pos", "token", *[c.alias(n) for n, c in _read_token(F.col("token")).items()])
    word = F.lower(strip(F.col("value")))
    is_filter = ((F.col("key") == "no") & word.isin(*MISSING)) | ((F.col("key") == "status") & word.isin(*STATUSES))
    error = (
        F.when(~F.col("closed"), F.lit("Close the quote"))
        .when((F.col("key") != "") & (F.col("value") == ""), F.concat("key", F.lit(": requires a value")))
        .when((F.col("key") == "no") & ~is_filter, F.concat(F.lit("no:"), "value", F.lit(" is not a supported filter")))
        .when((F.col("key") == "status") & ~is_filter, F.concat(F.lit("status:"), "value", F.lit(" is not a supported status")))
    )
    rows = read.withColumn("is_filter", is_filter).withColumn("token_error", error).withColumn("is_clause", F.col("value") != "")
    verdict = rows.groupBy("shelf_id").agg(
        F.min_by("token_error", F.when(F.col("token_error").isNotNull(), F.col("pos"))).alias("first_error"),
        F.bool_or("is_clause").alias("any_clause"), F.bool_or("is_filter").alias("any_filter"),
        F.max(F.when(F.col("is_clause") & (F.col("key") == ""), F.col("pos"))).alias("last_free"))
    verdict = verdict.select(
        "shelf_id", "last_free",
        F.coalesce("first_error", F.when(~F.col("any_clause"), F.lit("Search query needs at least one term")), F.lit("")).alias("error"),
        "any_filter")
    return rows.join(verdict, "shelf_id").where("is_clause OR token_error IS NOT NULL").select(
        "shelf_id", F.col("pos").cast("long").alias("pos"), "token", "key", "value", "quoted", "exact",
        (~F.col("quoted") & ((F.col("key") != "") | F.col("pos").eqNullSafe(F.col("last_free")))).alias("prefix"),
        "is_filter", "error", ((F.col("error") == "") & ~F.col("any_filter")).alias("may_grant_access"))


def vocabulary_matches(index: SearchIndex, words: DataFrame) -> DataFrame:
    """Dictionary terms filling each wanted word: equal ones, and for prefixes every term
    starting with it, found by an equi-join on the terms' own leading parts.

    Only leading parts as long as some wanted prefix are made; tag keys are no words.
    """
    vocabulary = index.terms().where("field <> 'tag_keys'").select("term").distinct()
    whole = words.where(~F.col("is_prefix")).withColumn("term", F.col("word"))
    sizes = words.where("is_prefix").agg(F.collect_set(F.length("word"))).scalar()
    lead = vocabulary.withColumn("sizes", sizes).select("term", F.explode(F.transform(
        F.filter("sizes", lambda n: n <= F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("word"))
    open_ended = words.where("is_prefix").join(lead, "word")
    return whole.unionByName(open_ended.select(*whole.columns))


def saved_clause_terms(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """(shelf_id, pos, want, n, place, term): the dictionary terms that may fill each place of each clause.

    ``want`` is the field, or empty for any field of text. Quoted and exact tag
    selectors are clauses of one place over the tag keys: the tag itself or, unless
    exact, a tag below it.
    """
    selector = F.col("key").isin("tag", "genre") & (F.col("quoted") | F.col("exact"))
    field = F.create_map(*[F.lit(x) for pair in FIELD_OF.items() for x in pair])[F.col("key")]
    spread = terms.where(~selector).withColumn("words", tokens(F.col("value"))).select(
        "shelf_id", "pos", F.coalesce(field, F.lit("")).alias("want"), F.size("words").alias("n"), "prefix",
        F.posexplode("words").alias("place", "word"))
    words = spread.withColumn("is_prefix", F.col("prefix") & (F.col("place") == F.col("n") - 1)).drop("prefix")
    token = F.concat(F.substring("key", 1, 1), F.sha2(tag_key(F.col("value")), 256))
    keys = terms.where(selector).select(
        "shelf_id", "pos", F.lit("tag_keys").alias("want"), F.lit(1).alias("n"), F.lit(0).alias("place"),
        F.explode(F.when(F.col("exact"), F.array(token)).otherwise(F.array(token, F.concat(F.lit("b"), token)))).alias("term"))
    return vocabulary_matches(index, words).select(*keys.columns).unionByName(keys)


def _in_field() -> Column:
    return F.when(F.col("want") == "", F.col("field") != "tag_keys").otherwise(F.col("field") == F.col("want"))


def _standing(filled: DataFrame) -> DataFrame:
    """(shelf_id, pos, book_id) of the clauses whose places are all filled, one after the other in one field.

    A position of a field holds one term, so a start has each place at most once.
    """
    right = filled.where(_in_field())
    single = right.where("n = 1").select("shelf_id", "pos", "book_id")
    phrases = right.where("n > 1").groupBy("shelf_id", "pos", "book_id", "field", (F.col("at") - F.col("place")).alias("start"), "n").agg(
        F.count("*").alias("got")).where("got = n").select("shelf_id", "pos", "book_id")
    return single.unionByName(phrases).distinct()


def clause_costs(index: SearchIndex, filled: DataFrame) -> DataFrame:
    """(shelf_id, pos, cost): the most books that a clause can match, by the frequencies of its rarest place; 0 if a place has no term."""
    known = filled.join(index.terms(), "term", "left").withColumn("books", F.when(_in_field(), F.col("books")))
    places = known.groupBy("shelf_id", "pos", "place", "n").agg(F.coalesce(F.sum("books"), F.lit(0)).alias("books"))
    return places.groupBy("shelf_id", "pos").agg(
        F.when(F.count("*") == F.max("n"), F.min("books")).otherwise(0).cast("long").alias("cost"))


def evaluate_saved_queries(index: SearchIndex, shelves: DataFrame, eligible_only: bool = True) -> DataFrame:
    """(shelf_id, book_id): books for which every clause of a saved search holds.

    Only searches made of words and tag selectors can define access; searches
    with lint errors match nothing. Equal searches of different shelves are
    evaluated once, for the lowest shelf, and then given to all of them, without a
    shuffle while no more than a million shelves have one. Each search
    starts from the clause that the fewest books can match, by the index's term
    frequencies; its other clauses are looked up for the books found.
    """
    stored = shelves.where(F.col("kind") == "query").select(F.col("id").alias("shelf_id"), strip(F.col("query")).alias("query"))
    once = stored.groupBy("query").agg(F.min("shelf_id").alias("first_shelf"))
    leads = shelves.join(once.select(F.col("first_shelf").alias("id")), "id", "left_semi")
    terms = saved_query_terms(leads).where(F.col("may_grant_access") if eligible_only else F.col("error") == "")
    terms = cut_lineage(terms.where(~F.col("is_filter")).select("shelf_id", "pos", "key", "value", "quoted", "exact", "prefix"))
    filled = cut_lineage(saved_clause_terms(index, terms))
    # A clause without words in it has no row in ``filled`` and matches nothing, like one whose words the index lacks.
    costs = terms.select("shelf_id", "pos").join(clause_costs(index, filled), ["shelf_id", "pos"], "left").select(
        "shelf_id", "pos", F.coalesce("cost", F.lit(0)).alias("cost"))
    order = costs.groupBy("shelf_id").agg(F.min_by("pos", F.struct("cost", "pos")).alias("first"), F.min("cost").alias("least"),
                                          F.count(F.lit(1)).alias("need")).where("least > 0").select("shelf_id", "first", "need")
    planned = cut_lineage(filled.join(order, "shelf_id"))
    leading = planned.where("pos = first")
    opening = (index.postings if index.books is None else index.of_terms(leading)).withColumnRenamed("pos", "at")
    begun = cut_lineage(_standing(opening.join(if_small(leading), "term")).select("shelf_id", "book_id"))
    # The other clauses look up the books found so far; their postings are not read as a whole.
    others = planned.where("pos <> first").select("shelf_id", "pos", "want", "n", "place", "term")
    named = index.of_terms(others).withColumnRenamed("pos", "at")
    more = _standing(begun.join(if_small(others), "shelf_id").join(named, ["term", "book_id"])).groupBy("shelf_id", "book_id").agg(F.count(F.lit(1)).alias("got"))
    held = begun.join(order.select("shelf_id", "need"), "shelf_id").join(more, ["shelf_id", "book_id"], "left")
    found = held.where(F.coalesce("got", F.lit(0)) + 1 == F.col("need")).select(F.col("shelf_id").alias("first_shelf"), "book_id")
    # Few rows become many: the books of a search meet its shelves where they lie, so a frequent search is no one task's work.
    equal = cut_lineage(stored.join(once, "query").select("shelf_id", "first_shelf"))
    dealt = found.repartition(int(shelves.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id")
    return dealt.join(if_small(equal, 1_000_000), "first_shelf").select("shelf_id", "book_id")


def rename_in_saved_queries(shelves: DataFrame, renames: DataFrame) -> DataFrame:
    """Stored searches whose quoted or exact tag selectors follow a branch rename.

    ``renames`` is (kind, name_key, new_name). Free words and the text between
    tokens stay as typed; searches with lint errors are left alone.
    """
    valid = saved_query_terms(shelves).where("error = ''").select(F.col("shelf_id").alias("id")).distinct()
    stored = shelves.where(F.col("kind") == "query").join(valid, "id", "left_semi").select(
        F.col("id").alias("shelf_id"), strip(F.col("query")).alias("query"))
    pieces = stored.select("shelf_id", F.posexplode(
        F.regexp_extract_all("query", F.lit(rf"({TOKEN}|{SPACE}+)"), F.lit(1))).alias("pos", "token"))
    read = pieces.select("shelf_id", "pos", "token", *[c.alias(n) for n, c in _read_token(F.col("token")).items()])
    selector = F.col("key").isin("tag", "genre") & (F.col("quoted") | F.col("exact"))
    targets = renames.select(F.col("kind").alias("key"), F.col("name_key").alias("path"), "new_name")
    keyed = read.withColumn("path", F.when(selector, tag_key(F.col("value"))))
    moved = keyed.join(targets, ["key", "path"], "left")
    quoted_name = F.concat(F.lit('"'), F.replace(F.col("new_name"), F.lit('"'), F.lit('""')), F.lit('"'))
    written = F.concat("key", F.when(F.col("exact"), F.lit(":=")).otherwise(F.lit(":")), quoted_name)
    # The pieces of one stored query are one row's worth of text.
    return (
        moved.withColumn("out", F.coalesce(F.when(F.col("new_name").isNotNull(), written), F.col("token")))
        .groupBy("shelf_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("parts"),
            F.bool_or(F.col("new_name").isNotNull()).alias("changed"))
        .where("changed").select("shelf_id", F.array_join("parts.out", "").alias("query"))
    )
