"""The segmented index: edits write little, readers see what a full build gives, merges and versions."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import search, segments
from tests.test_catalog import catalog

WORDS = ["red", "gear", "Édition", "bolt", "三体", "widget", "asia", "small"]


def built(c):
    return search.build_search_index(c.books, c.authors, c.book_authors, c.tags, c.book_tags, c.assets)


def content(index):
    return (sorted(map(tuple, index.postings.select("book_id", "field", "term", "pos").collect())),
            sorted(map(tuple, index.lengths.select("book_id", "length").collect())))


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "book_id long")


def with_titles(spark, titles):
    """A catalogue of (id -> title), each book with an author, a tag and a file."""
    full = catalog(spark, [titles.get(i, "") for i in range(1, max(titles, default=0) + 1)],
                   authors=[{"id": 1, "name": "Jo Red", "sort_name": "Red, Jo"}], tags=[{"id": 1, "kind": "tag", "name": "Asia.Small", "name_key": "asia.small"}],
                   links=[{"book_id": i, "author_id": 1, "author_order": 0} for i in titles],
                   book_tags=[{"book_id": i, "tag_id": 1, "position": 0} for i in titles],
                   assets=[{"id": 10 + i, "book_id": i, "filename": f"{i}.epub"} for i in titles])
    full._tables["books"] = full.books.where(F.col("id").isin(*titles))
    return full


def written(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_an_edit_writes_only_its_books(spark, tmp_path):
    titles = {i: f"{WORDS[i % 8]} book {i}" for i in range(1, 301)}
    store = segments.IndexStore(spark, str(tmp_path))
    store.create(lambda: built(with_titles(spark, titles)))
    before = written(tmp_path)
    base = store.segments()[0]
    titles.update({100: "gear edited", 301: "new gear"})
    del titles[200]
    after = with_titles(spark, titles)
    changed = ids(spark, 100, 200, 301, 301)
    store.update(changed, lambda books: segments.build_for(books, after))
    assert {p: t for p, t in written(tmp_path).items() if p in before} == before
    old, new = store.segments()
    assert old == base and new.books == 3 and new.rows < base.rows / 50
    assert content(store.current()) == content(built(after))
    counted = {(r.field, r.term): r.books for r in store.current().terms().collect()}
    true = {(r.field, r.term): r.books for r in built(after).terms().collect()}
    assert all(counted[k] >= n for k, n in true.items())


def test_any_run_of_edits_equals_a_full_build(spark, tmp_path):
    rng = random.Random(7)
    titles = {i: f"{rng.choice(WORDS)} {rng.choice(WORDS)}" for i in range(1, 41)}
    store = segments.IndexStore(spark, str(tmp_path))
    store.create(lambda: built(with_titles(spark, titles)))
    for _ in range(4):
        touched = rng.sample(range(1, 50), 6)
        for i in touched:
            if i in titles and rng.random() < 0.4:
                del titles[i]
            else:
                titles[i] = f"{rng.choice(WORDS)} again"
        now = with_titles(spark, titles)
        store.update(ids(spark, *touched), lambda books: segments.build_for(books, now))
        assert content(store.current()) == content(built(now))
    sizes = [s.size for s in store.segments()]
    assert all(a > segments.RATIO * sum(sizes[i + 1:]) for i, a in enumerate(sizes[:-1]))
    store.merge(ratio=10**9)
    assert len(store.segments()) == 1 and content(store.current()) == content(built(now))
    assert sorted(map(tuple, store.current().terms().collect())) == sorted(map(tuple, built(now).terms().collect()))
    gone = store.vacuum(keep=1)
    assert gone and content(store.current()) == content(built(now)) and store.vacuum(keep=1) == []


def test_versions(spark, tmp_path):
    store = segments.IndexStore(spark, str(tmp_path))
    assert store.versions() == [] and store.segments() == [] and store.merge() is None
    one = with_titles(spark, {1: "red"})
    first = store.create(lambda: built(one))
    store.create(lambda: pytest.fail("built twice"))
    empty = with_titles(spark, {})
    staged = store.staged_update(spark.createDataFrame([(1,), (None,)], "book_id long"), lambda books: segments.build_for(books, empty))
    assert store.versions() == [1]  # staged only
    store.commit(staged, 1)
    with pytest.raises(FileExistsError):
        store.commit(staged, 1)
    assert content(store.current()) == ([], []) and content(first) == content(built(one))  # the older reader goes on
    assert content(store.view(store.segments(1))) == content(built(one))


def test_an_empty_catalogue(spark, tmp_path):
    store = segments.IndexStore(spark, str(tmp_path))
    assert content(store.create(lambda: built(with_titles(spark, {})))) == ([], [])
    now = with_titles(spark, {1: "red gear"})
    store.update(ids(spark, 1), lambda books: segments.build_for(books, now))
    assert content(store.current()) == content(built(now))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_built_index_is_read_without_another_shuffle(spark, tmp_path):
    index = built(with_titles(spark, {1: "red gear red", 2: "red"}))
    assert "Exchange" not in plan_of(index.postings) and "Window" not in plan_of(index.lengths)
    assert {(r.field, r.term): r.books for r in index.terms().collect()} == {(r.field, r.term): r.books for r in search.term_frequencies(index.postings).collect()}
    index.write(str(tmp_path))
    assert content(search.SearchIndex.read(spark, str(tmp_path))) == content(index)


def test_pieces_without_a_place_or_a_book_count_for_lengths_only(spark):
    rows = [(1, "authors", 5, 2, "c d"), (1, "authors", 5, 1, "a b"), (1, "authors", None, 1, "x y z"), (1, "title", 0, 0, ""), (2, "title", 0, 0, ""),
            (None, "title", 0, 0, "lost"), (1, "authors", 9000, 0, "a"), (3, "title", 0, 0, None)]
    index = search.index_values(spark.createDataFrame(rows, "book_id long, field string, at long, tie long, text string"),
                                spark.createDataFrame([(1, "gk"), (None, None)], "book_id long, term string"))
    places = [(1, "authors", t, p) for t, p in (("a", 3), ("b", 4), ("c", 5), ("d", 6), ("a", 7))]
    assert sorted(map(tuple, index.postings.where("term IS NOT NULL").collect())) == sorted([*places, (1, "tag_keys", "gk", 0)])
    assert index.postings.where("term IS NULL").count() == 1
    assert {r.book_id: r.length for r in index.lengths.collect()} == {1: 9, 2: 0, None: 2, 3: None}
