"""Small catalogues: search, hierarchy, series, duplicates, exports, pages."""

import html

import pytest
from pyspark.sql import functions as F

from foliant.functions import markup, prose
from foliant.operators import browse, dedupe, edit, search
from foliant.sources.catalog import SCHEMAS, Catalog, load_catalog


def rows(spark, table, *items):
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(i.get(f.name) for f in schema.fields) for i in items], schema)


def catalog(spark, titles, **extra):
    books = [{"id": i, "title": t, "sort_title": t, "added_at": i, "cover_version": 1, **extra.get(f"b{i}", {})} for i, t in enumerate(titles, 1)]
    return Catalog.of(
        spark, books=rows(spark, "books", *books), authors=rows(spark, "authors", *extra.get("authors", [])),
        book_authors=rows(spark, "book_authors", *extra.get("links", [])), tags=rows(spark, "tags", *extra.get("tags", [])),
        book_tags=rows(spark, "book_tags", *extra.get("book_tags", [])), assets=rows(spark, "assets", *extra.get("assets", [])),
        reading_state=rows(spark, "reading_state", *extra.get("state", [])))


def found(c, q, user=1):
    index = search.build_search_index(c.books, c.authors, c.book_authors, c.tags, c.book_tags, c.assets)
    return [r.id for r in browse.page(search.search(c, index, q, user), browse.list_keys("relevance"), 50).orderBy("rn").collect()]


def test_words_prefixes_and_phrases(spark):
    c = catalog(spark, ["Foundation and Böses Ende", "Foundation Bay", "Война и мир", "三体"],
                authors=[{"id": 1, "name": "Isaac Asimov", "sort_name": "Asimov, Isaac"}], links=[{"book_id": 1, "author_id": 1, "author_order": 0}])
    assert sorted(found(c, "foundation b")) == [1, 2]
    assert found(c, 'f ba author:"Isaac Asimov"') == []
    assert found(c, '"foundation ba"') == [] and found(c, '"foundation bay"') == [2] and found(c, "...") == []
    assert found(c, "boses") == [1] and found(c, "вой") == [3] and found(c, "三") == [4]


def test_rank_by_field_and_filters(spark):
    c = catalog(spark, ["needle", "x one", "x two", "x three"], b3={"series": "needle"}, b4={"description": "needle", "cover_version": 0},
                authors=[{"id": 1, "name": "needle", "sort_name": "n"}], links=[{"book_id": 2, "author_id": 1, "author_order": 0}],
                state=[{"user_id": 1, "book_id": 3, "status": "finished"}])
    assert found(c, "needle") == [1, 2, 3, 4]
    assert found(c, "no:cover need") == [4] and found(c, "status:finished need") == [3] and sorted(found(c, "status:unread")) == [1, 2, 4]


def test_tag_branches(spark):
    names = ["Fiction", "Fiction.Science Fiction", "Fiction.Science Fiction.Space Opera", "Fiction.Fantasy", "Fictional"]
    tags = [{"id": i, "name": n, "name_key": n.lower(), "kind": "genre", "parent_id": p} for i, (n, p) in enumerate(zip(names, [None, 1, 2, 1, None]), 1)]
    links = [{"book_id": 1, "tag_id": 3, "position": 0}, {"book_id": 2, "tag_id": 4, "position": 0}, {"book_id": 3, "tag_id": 1, "position": 0},
             {"book_id": 4, "tag_id": 5, "position": 0}, {"book_id": 5, "tag_id": 1, "position": 0}]
    c = catalog(spark, list("abcde"), b5={"deleted_at": 9}, tags=tags, book_tags=links)
    assert sorted(found(c, 'genre:"fiction"')) == [1, 2, 3] and found(c, 'genre:="Fiction"') == [3]
    counts = {r.name: (r.book_count, r.has_children) for r in browse.tag_counts(c.books, c.tags, c.book_tags, "genre").collect()}
    assert counts == {"Fiction": (3, True), "Fictional": (1, False)}
    nodes, moved = edit.rename_tag(c.tags, c.book_tags, 2, "Science")
    assert "Science.Space Opera" in {r.name for r in nodes.collect()} and ("science.space opera", 1) in {(r.name_key, r.book_id) for r in moved.collect()}
    with pytest.raises(ValueError):
        edit.rename_tag(c.tags, c.book_tags, 1, "Fiction.Deeper")


def test_duplicates_and_dismissals(spark):
    c = catalog(spark, ["Foundation", "foundation!", "Foundation", "Foundation"], b4={"deleted_at": 5})
    first = spark.createDataFrame([(1, "isaac   asimov"), (2, "Isaac Asimov"), (3, "Other"), (4, "Isaac Asimov")], "book_id long, name string")
    keyed = dedupe.keyed_books(c.books, first)
    groups = dedupe.duplicate_groups(keyed)
    assert [(r.key, r.size) for r in groups.collect()] == [("foundation|isaac asimov", 2)]
    key = "foundation|isaac asimov"
    dismissed = spark.createDataFrame([(1, "title_author", key, 1), (1, "title_author", key, 2)], "dismissal_id long, reason string, key string, book_id long")
    assert dedupe.apply_dismissals(keyed, groups, dismissed).count() == 0
    assert dedupe.apply_dismissals(keyed, groups, dismissed.where("book_id = 1")).count() == 1


def test_sequence_and_jumps(spark):
    c = catalog(spark, ["b", "A", "éa", "7up", "(x)", "B2"])
    window = {r.id: (r.rn, r.total) for r in browse.sequence_window(browse.live(c.books), browse.list_keys("title"), 1, 1, 1).collect()}
    assert window == {2: (3, 6), 1: (4, 6), 6: (5, 6)}
    jumps = {r.label: r.offset for r in browse.book_jumps(c.books, "title").collect()}
    assert jumps == {"#": 0, "0–9": 1, "A": 2, "B": 3, "É": 5}


def test_cells_stop_implied_ends(spark):
    """A sibling ends open elements only up to the nearest cell; a row looks past it."""
    words = "word " * 5000
    cases = {"<p hidden><td><p>" + "<p>x" * 100: 0, "<li hidden>a<th>b<li>c": 0, "<table><td hidden>" + words + "<td>x": 1,
             "<tr hidden><td>" + words + "<tr><td>x": 1, "<p hidden>" + words + "<p>x": 1}
    found = markup.estimate_pages_html(spark.createDataFrame(list(enumerate(cases)), "page_id int, html string"), "page_id", "html")
    assert [r["pages"] for r in found.orderBy("page_id").collect()] == list(cases.values())


def test_markup_helpers(spark):
    page = ("<html><head><title>x</title><style>b{}</style></head><body><p onclick=x>Hi <b>there</b><script>alert(1)</script>"
            "<p><a href='javascript:1'>a</a><a href='https://x.y?a=1&amp;b'>l</a><div>d<br></div></body></html>")
    assert markup.sanitize(page) == ('<p>Hi <b>there</b></p><p><a>a</a><a href="https://x.y?a=1&amp;b" rel="noopener noreferrer">l</a>d<br></p>')
    cases = {"<p>" + "word " * 14 * 37 + "</p>": 2, "<div hidden>" + "word " * 5000 + "</div><p>x</p>": 1, "<img>" * 4: 2, "": 0,
             "<ul><li hidden>" + "word " * 5000 + "<li>x</ul>": 1, "<div style='Display: none'><div>" + "word " * 5000 + "</div>w</div>x": 1,
             "<pre>" + "a\n" * 40 + "</pre>": 2, "<head><title>" + "word " * 5000 + "</title><body>x": 1, "<p>a&amp;b</p>" * 37: 2,
             "<svg viewBox='0 0 480 7200'><text>" + "word " * 5000 + "</text></svg>x": 2, "<img width=20 height=20>" * 100: 1}
    found = markup.estimate_pages_html(spark.createDataFrame(list(enumerate(cases)), "page_id int, html string"), "page_id", "html")
    assert [r["pages"] for r in found.orderBy("page_id").collect()] == list(cases.values())
    texts = ["&amp;&lt;&eacute;&notit;&#65;&#x1F600;&#128;&copy &nope; a & b", "plain", "&amp"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(markup.unescape(F.col("t")))
    assert [r[0] for r in df.collect()] == [html.unescape(t) for t in texts]
    df = spark.createDataFrame([("<p>A&amp;B</p><!-- c --><li>x",)], "h string")
    assert df.select(markup.html_to_text(F.col("h"))).first()[0] == "A&B x"


def test_text_helpers(spark):
    df = spark.createDataFrame([("One. Two! 3.14 \"End.\" x",)], "t string")
    assert df.select(prose.sentences(F.col("t"))).first()[0] == ["One. ", "Two! ", "3.", "14 \"End.\" ", "x"]
    hits = df.select(prose.search_in_text(F.col("t"), "TW")).first()[0]
    assert [(h.at, h.pre, h.match, h.post) for h in hits] == [(5, "One. ", "Tw", 'o! 3.14 "End." x')]
    wide = spark.createDataFrame([("三" * 36 * 36,), ("",), ("a\n\n\nb",)], "t string")
    assert [r[0] for r in wide.select(prose.estimate_pages_text(F.col("t"))).collect()] == [2, 0, 1]
    russian = spark.createDataFrame([(bytearray("Привет, мир".encode("cp1251")),), (bytearray("caf\xe9 \x93q\x94".encode("latin-1")),)], "b binary")
    assert [r[0] for r in russian.select(prose.decode_text(F.col("b"))).collect()] == ["Привет, мир", "café “q”"]


def test_typed_load(spark, tmp_path):
    rows(spark, "authors", {"id": 1, "name": "a", "sort_name": "a"}).write.parquet(str(tmp_path / "authors.parquet"))
    assert load_catalog(spark, str(tmp_path)).authors.count() == 1
