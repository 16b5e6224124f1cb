"""What keeps large catalogues in bounds: searches nobody is assigned to, rows dealt before heavy text work, one row a request."""

from pyspark.sql import functions as F

from foliant.functions import paths
from foliant.operators import matching, scope, search
from foliant.plans import load_all, q_search
from foliant.plans.registry import JOBS
from foliant.sources.catalog import Catalog
from foliant.sources.files import dedupe_import
from tests.test_catalog import rows

load_all()


def readers(spark):
    users = rows(spark, "users", *[{"id": i, "username": f"u{i}", "role": "reader", "content_scope": "shelves"} for i in (1, 2, 3, 4)],
                 {"id": 9, "username": "all", "role": "member", "content_scope": "all"})
    shelves = rows(spark, "shelves", *[{"id": i, "kind": "manual", "owner_id": 9, "visibility": "shared"} for i in (1, 2)],
                   *[{"id": i, "kind": "query", "query": q, "query_match": q, "owner_id": 9, "visibility": "shared"} for i, q in ((5, "red"), (6, "blue"))])
    given = rows(spark, "user_scope_shelves", *[{"user_id": u, "shelf_id": s} for u, s in ((1, 1), (1, 2), (2, 2), (2, 1), (3, 5), (3, 1), (9, 6))])
    books = rows(spark, "shelf_books", *[{"shelf_id": s, "book_id": b} for s, b in ((1, 7), (1, 7), (1, 8), (2, 7), (2, None), (4, 5))])
    return users, shelves, given, books


def test_groups_see_each_book_once_and_are_not_shuffled(spark):
    matches = spark.createDataFrame([(5, 8), (5, 20), (6, 30)], "shelf_id long, book_id long")
    users, shelves, given, books = readers(spark)
    seen = scope.visible_books_all(users, shelves, given, books, matches)
    assert sorted((r.user_id, r.book_id or 0) for r in seen.collect()) == [
        (1, 0), (1, 7), (1, 8), (2, 0), (2, 7), (2, 8), (3, 7), (3, 8), (3, 20)]
    assert "hashpartitioning(shelves" not in seen._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_only_assigned_searches_are_evaluated(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(q_search, "index_of", lambda c: None)
    monkeypatch.setattr(q_search.search, "evaluate_saved_queries", lambda index, shelves: asked.extend(
        r.id for r in shelves.where("kind = 'query'").collect()) or spark.createDataFrame([(5, 20)], "shelf_id long, book_id long"))
    users, shelves, given, books = readers(spark)
    JOBS["visible_books_all"](Catalog.of(spark, users=users, shelves=shelves, user_scope_shelves=given, shelf_books=books)).collect()
    assert asked == [5]


def test_segments_are_made_once_and_where_the_rows_lie(spark):
    documents = spark.createDataFrame([(i, f"a: {'é' * i}") for i in range(0, 300, 50)], "doc_id long, text string").repartition(3, "doc_id")
    made = JOBS["render_book_path_long"](Catalog.of(spark, documents=documents))
    assert {(r.id, r.was_long) for r in made.collect()} == {(i, i > 126) for i in range(0, 300, 50)}
    below = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("Exchange hashpartitioning")[1]
    assert "regexp_replace" not in below


def test_candidates_are_parsed_once_and_where_the_rows_lie(spark):
    text = spark.createDataFrame([(1, i, j) for i, j in enumerate(['{"key":"k","title":"t"}', '{"title":""}', None, "x"])], "query_id long, idx long, json string")
    made = matching.normalize_catalog_rows(text.repartition(3, "idx"))
    assert [(r.idx, r.provider_id, r.title) for r in made.collect()] == [(0, "k", "t")]
    assert "from_json" not in made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("Exchange hashpartitioning")[1]


def test_safe_segments_of_odd_names(spark):
    names = {"plain name": "plain name", " . a  b. ": "a b.", "a b": "a b", "a  b\n": "a b", 'x<>:"/\\|?*\x00y': "xy", "\x85": "", "..": "",
             ":": "", "a :": "a", ": b": "b", "é\tü": "é ü", "": "", None: None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", paths.safe_segment(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names


def test_long_segments_keep_whole_characters_of_both_ends(spark):
    texts = ["é" * 200, "a" * 300, "😀" * 100 + "b", "a" * 255, "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(paths.short_segment(F.col("t"))).collect()]
    assert got[3:] == texts[3:] and all(len(s.encode()) <= 255 for s in got[:3])
    assert [(s.split("~")[0], s.split("~")[2]) for s in got[:3]] == [("é" * 59, "é" * 59), ("a" * 118, "a" * 119), ("😀" * 29, "😀" * 29 + "b")]


def test_a_request_meets_one_row_of_its_book(spark):
    files = rows(spark, "assets", *[{"id": i, "book_id": 1, "format": f, "is_primary": p, "original_size": s} for i, f, p, s in (
        (1, "pdf", True, 5), (2, "txt", False, 5), (3, "fb2", False, 5), (4, "epub", False, 1 << 40))], {"id": 5, "book_id": 2, "format": "epub", "original_size": 1 << 40},
        {"id": 6, "book_id": None, "format": "epub", "original_size": 1})
    asked = spark.createDataFrame([(1, 1, "kindle"), (2, 1, "pocketbook"), (3, 1, "generic"), (4, 2, "kindle"), (5, 3, "kindle"), (6, None, "kindle"), (7, 1, None),
                                   (8, 2, "kindle"), (8, 1, "pocketbook"), (8, 1, "pocketbook")], "request_id long, book_id long, preset string")
    plan = matching.plan_delivery(asked, files)
    assert {r.request_id: (r.asset_id, r.format, r.target, r.reason) for r in plan.collect()} == {
        1: (3, "fb2", "epub", ""), 2: (3, "fb2", "", ""), 3: (None, None, None, "no_compatible_format"), 4: (None, None, None, "too_large"),
        5: (None, None, None, "no_compatible_format"), 6: (None, None, None, "no_compatible_format"), 7: (None, None, None, "no_compatible_format"), 8: (3, "fb2", "", "")}
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Join LeftOuter") < tree.rindex("Aggregate [book_id")


def test_the_index_is_built_in_small_partitions_and_settings_come_back(spark, monkeypatch):
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"]
    seen, real = [], search.written
    before = [spark.conf.get(k, None) for k in keys]
    monkeypatch.setattr(search, "written", lambda df: seen.extend(spark.conf.get(k) for k in keys) or real(df))
    pieces = spark.createDataFrame([(1, "title", 0, 0, "red red gear"), (1, "title", 1, 0, "gear"), (2, "series", 0, 0, None)],
                                   "book_id long, field string, at long, tie long, text string")
    index = search.index_values(pieces)
    assert seen == ["8m", "256", "8m"] and [spark.conf.get(k, None) for k in keys] == before
    assert sorted((r.term, r.pos) for r in index.postings.collect()) == [("gear", 2), ("gear", 3), ("red", 0), ("red", 1)]


def test_equal_searches_meet_their_books_without_a_shuffle(spark):
    pieces = spark.createDataFrame([(b, "title", 0, 0, t) for b, t in ((1, "red gear"), (2, "red"), (3, "blue"))],
                                   "book_id long, field string, at long, tie long, text string")
    shelves = rows(spark, "shelves", *[{"id": i, "kind": "query", "query": q, "query_match": q or "", "owner_id": 9, "visibility": "shared"} for i, q in (
        (1, "red"), (2, " red "), (3, "red"), (3, "red"), (4, "blue"), (5, None), (6, "red gear"), (7, "green"))])
    found = search.evaluate_saved_queries(search.index_values(pieces), shelves)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 1), (3, 2), (3, 2), (4, 3), (6, 1)]
    assert "hashpartitioning(first_shelf" not in found._jdf.queryExecution().executedPlan().toString()


def counted(spark, df, column):
    """``df`` and a count of how often its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def same(value):
        made.add(1)
        return value

    return df.withColumn(column, F.udf(same, df.schema[column].dataType).asNondeterministic()(column)), made


def test_requests_are_read_in_one_job_and_limited_readers_need_a_shelf(spark):
    users, shelves, given, books = readers(spark)
    users = users.unionByName(users.where("id = 1"))
    files = rows(spark, "assets", {"id": 70, "book_id": 7}, {"id": 80, "book_id": None})
    stock = rows(spark, "books", *[{"id": b, "title": "t", "deleted_at": 5 if b == 20 else None} for b in (7, 8, 20, 30)])
    told = [(1, "live", 7), (1, "live", 30), (2, "asset", 70), (2, "asset", 80), (2, "asset", 1), (3, "trashed", 20), (3, "live", 20), (4, "live", 7),
            (9, "live", 30), (9, "trashed", 30), (77, "live", 7), (None, "live", 7), (9, "live", None), (3, "live", None)]
    asked, made = counted(spark, spark.createDataFrame(told, "user_id long, kind string, target_id long"), "kind")
    found = spark.createDataFrame([(5, 8), (5, 20), (6, 30)], "shelf_id long, book_id long")
    got = scope.can_access(asked, users, scope.scope_shelves(users, shelves, given), books, lambda s, b: found, stock, files).collect()
    right = {told[i] for i in (0, 2, 5, 8)}
    # The account that is there twice has its rows four times, as the joins of its rows give them.
    assert sorted(map(str, got)) == sorted(f"Row(user_id={r[0]}, kind={r[1]!r}, target_id={r[2]}, allowed={r in right})"
                                           for r in told for _ in range(4 if r[0] == 1 else 1))
    assert made.value == 2 * len(told)  # those for files and the others


def test_a_limited_index_picks_terms_before_books(spark):
    pieces = spark.createDataFrame([(b, "title", 0, 0, t) for b, t in ((1, "red gear"), (2, "red"), (3, "blue"), (4, "red gear"))],
                                   "book_id long, field string, at long, tie long, text string")
    index = search.index_values(pieces).within(spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "book_id long"))
    named = index.of_terms(spark.createDataFrame([("red",), ("red",), ("gear",)], "term string"))
    assert sorted((r.book_id, r.term, r.pos) for r in named.collect()) == [(1, "gear", 1), (1, "red", 0), (2, "red", 0)]
    tree = named._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("(book_id") < tree.index("(term")
    shelves = rows(spark, "shelves", *[{"id": i, "kind": "query", "query": q, "query_match": q, "owner_id": 9, "visibility": "shared"} for i, q in (
        (1, "red"), (2, "red gear"), (3, "blue"))])
    assert sorted(map(tuple, search.evaluate_saved_queries(index, shelves).collect())) == [(1, 1), (1, 2), (2, 1), (3, 3)]


def test_import_candidates_are_made_once(spark):
    told = [(1, 7, "a"), (2, 7, "b"), (3, 9, "a"), (4, 1, "x"), (5, 1, "x"), (6, 7, "t"), (7, None, "a"), (8, 7, None), (8, 7, "a"), (None, 7, "a"), (9, 7, "gone")]
    candidates, made = counted(spark, spark.createDataFrame(told, "id long, size long, hash string"), "hash")
    assets = rows(spark, "assets", {"id": 31, "book_id": 1, "original_hash": "a", "current_hash": "b", "original_size": 7, "current_size": None},
                  {"id": 30, "book_id": 2, "original_hash": "a", "current_hash": "a", "original_size": 8, "current_size": 7},
                  {"id": 32, "book_id": 3, "original_hash": "t", "current_hash": None, "original_size": 7, "current_size": 7},
                  {"id": 33, "book_id": 99, "original_hash": "gone", "current_hash": "gone", "original_size": 7, "current_size": 7})
    got = dedupe_import(candidates, assets, rows(spark, "books", *[{"id": b, "title": "t", "deleted_at": 5 if b == 3 else None} for b in (1, 2, 3)])).collect()
    # Rows of one id share what the others found, as before.
    assert sorted(tuple(str(x) for x in r) for r in got) == sorted(tuple(str(x) for x in r) for r in [
        (1, "duplicate", 30, 2), (2, "duplicate", 31, 1), (3, "duplicate", None, None), (4, "imported", None, None), (5, "duplicate", None, None),
        (6, "duplicate_trashed", 32, 3), (7, "duplicate", None, None), (8, "duplicate", 30, 2), (8, "duplicate", 30, 2), (None, "imported", None, None),
        (9, "imported", None, None)])
    assert made.value == len(told)
