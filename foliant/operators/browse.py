"""Listings, pages, windows and counts over the live catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.ordering import Key, first_per, nocase, page, row_before, sorts
from foliant.functions.tagging import path_prefixes, tag_key

SUMMARY = ["id", "title", "series", "series_index", "cover_version", "published_date"]
PUBLICATION = ["id", "title", "description", "publisher", "published_date", "language",
               "identifiers", "cover_version", "updated_at"]
FINISHED_AT = 0.995


def blank(value: str) -> Column:
    return F.col(value).isNull() | (F.trim(F.col(value)) == "")


def live(books: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Books outside the trash, narrowed to a visible set of ``book_id`` if given."""
    kept = books.where(F.col("deleted_at").isNull())
    return within(kept, visible)


def within(books: DataFrame, visible: DataFrame | None, column: str = "id") -> DataFrame:
    if visible is None:
        return books
    return books.join(visible.select(F.col("book_id").alias(column)), column, "left_semi")


def volume_keys() -> list[Key]:
    """Numbered volumes in order, then the unnumbered ones by title."""
    numbered = F.coalesce(F.col("series_index") > 0, F.lit(False))
    return [
        Key(F.when(numbered, 0).otherwise(1)),
        Key(F.when(numbered, F.col("series_index")).otherwise(F.lit(0.0))),
        Key(nocase("title")),
    ]


def list_keys(sort: str) -> list[Key]:
    by_title = [Key(nocase("sort_title")), Key(nocase("title"))]
    keys = {
        "title": by_title,
        "author": [Key(F.col("primary_author_sort")), *by_title],
        "year": [Key(F.col("published_date"), desc=True, nulls_last=True), Key(F.col("added_at"), desc=True)],
        "series": [Key(F.when(blank("series"), 1).otherwise(0)), Key(nocase("series")), *volume_keys()],
        "relevance": [Key(F.col("score"))],
    }.get(sort, [Key(F.col("added_at"), desc=True)])
    return [*keys, Key(F.col("id"))]


def shelf_keys(sort: str) -> list[Key]:
    if sort in ("title", "author", "year", "series"):
        return list_keys(sort)
    return [Key(F.col("position")), Key(F.col("shelved_at"), desc=True), Key(F.col("added_at"), desc=True),
            Key(F.col("id"))]


def list_books(books: DataFrame, sort: str, limit: int, offset: int = 0, visible: DataFrame | None = None) -> DataFrame:
    """One page of the catalogue (or of ranked search hits, with a ``score`` column)."""
    return page(live(books, visible), list_keys(sort), limit, offset).select("rn", *SUMMARY)


def on_shelf(books: DataFrame, shelf_books: DataFrame, shelf_id: int, visible: DataFrame | None = None) -> DataFrame:
    rows = shelf_books.where(F.col("shelf_id") == shelf_id).select(
        F.col("book_id").alias("id"), "position", F.col("added_at").alias("shelved_at"))
    return live(books, visible).join(rows, "id")


def list_manual_shelf(books: DataFrame, shelf_books: DataFrame, shelf_id: int, sort: str, limit: int,
                      offset: int = 0, visible: DataFrame | None = None) -> DataFrame:
    return page(on_shelf(books, shelf_books, shelf_id, visible), shelf_keys(sort), limit, offset).select("rn", *SUMMARY)


def jump_label(value: Column) -> Column:
    """Initial letter in upper case, ``0–9`` for digits, ``#`` for the rest."""
    first = F.substring(value, 1, 1)
    return (
        F.when(first.rlike(r"^\p{L}"), F.upper(first))
        .when(first.rlike(r"^\p{Nd}"), F.lit("0–9"))
        .otherwise(F.lit("#"))
    )


def book_jumps(books: DataFrame, sort: str, visible: DataFrame | None = None) -> DataFrame:
    """Offset of the first book of each label in list order, plus the list length.

    The first key of each label is a small aggregate. Every row then falls between
    two of those keys, so the offsets are running sums of a histogram and the list
    is never sorted.
    """
    if sort not in ("title", "author"):
        raise ValueError("jumps need the title or author order")
    value = F.col("sort_title" if sort == "title" else "primary_author_sort")
    key = F.struct(*[k.expr.alias(f"k{i}") for i, k in enumerate(list_keys(sort))])
    rows = live(books, visible).select(jump_label(value).alias("label"), key.alias("key"))
    firsts = rows.groupBy("label").agg(F.min("key").alias("key"))
    bounds = firsts.agg(F.sort_array(F.collect_list(F.struct("key", "label"))).alias("bounds"))
    histogram = (
        rows.withColumn("bounds", bounds.scalar())
        .select(F.size(F.filter("bounds", lambda b: b["key"] <= F.col("key"))).alias("slot"))
        .groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = histogram.agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("counts"))
    return (
        bounds
        .select(F.posexplode("bounds").alias("slot", "b"), counts.scalar().alias("counts"))
        .select(
            F.col("b.label").alias("label"),
            F.aggregate(F.map_keys("counts"), F.lit(0).cast("long"),
                        lambda acc, s: acc + F.when(s <= F.col("slot"), F.col("counts")[s]).otherwise(0)).alias("offset"),
            F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda acc, n: acc + n).alias("total"),
        )
    )


def sequence_window(listing: DataFrame, keys: list[Key], book_id: int, before: int, after: int) -> DataFrame:
    """A book with its neighbours in a listing, their places, and the list length.

    The book's place is a count of the rows sorting before it and the
    neighbours are two top lists, so nothing numbers the whole listing.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = listing.select("id", "title", *[k.expr.alias(n) for k, n in zip(keys, names)])
    keyed = [Key(F.col(n), k.desc, k.nulls_last) for k, n in zip(keys, names)]
    current = rows.where(F.col("id") == book_id).select(F.struct(*names).alias("at")).limit(1)
    marked = rows.withColumn("at", current.scalar()).where(F.col("at").isNotNull())
    here = [F.col(f"at.{n}") for n in names]
    earlier = row_before(keyed, here)
    marked = marked.withColumn("side", F.when(F.col("id") == book_id, 0).when(earlier, -1).otherwise(1))
    place = marked.agg(F.struct(F.count_if(F.col("side") == -1).alias("earlier"), F.count(F.lit(1)).alias("total")))
    backwards = [Key(k.expr, not k.desc, not k.nulls_last) for k in keyed]
    left = page(marked.where("side = -1"), backwards, before, rank="step").withColumn("step", -F.col("step"))
    right = page(marked.where("side = 1"), keyed, after, rank="step")
    middle = marked.where("side = 0").withColumn("step", F.lit(0).cast("long"))
    return (
        left.unionByName(middle).unionByName(right)
        .withColumn("place", place.scalar())
        .select("id", "title", (F.col("place.earlier") + 1 + F.col("step")).alias("rn"),
                F.col("place.total").alias("total"), (F.col("id") == book_id).alias("is_current"))
    )


def book_detail(books: DataFrame, authors: DataFrame, book_authors: DataFrame, tags: DataFrame,
                book_tags: DataFrame, assets: DataFrame, ids: DataFrame | None = None,
                visible: DataFrame | None = None) -> DataFrame:
    """Detail rows with their ordered authors, genres, tags and file count."""
    wanted = live(books, visible)
    if ids is not None:
        wanted = wanted.join(ids, "id", "left_semi")
    keep = wanted.select(F.col("id").alias("book_id"))
    by_author = (
        book_authors.join(keep, "book_id", "left_semi").join(authors, book_authors.author_id == authors.id)
        .groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("author_order", "author_id", "name"))).alias("a"))
        .select("book_id", F.array_join("a.name", "; ").alias("authors"))
    )
    linked = book_tags.join(keep, "book_id", "left_semi").join(tags, book_tags.tag_id == tags.id)
    kinds = [
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "tag_id", "name")))).alias(kind)
        for kind in ("genre", "tag")
    ]
    by_tag = linked.groupBy("book_id").agg(*kinds).select(
        "book_id", F.array_join("genre.name", ", ").alias("genres"), F.array_join("tag.name", ", ").alias("tags"))
    by_asset = assets.join(keep, "book_id", "left_semi").groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_assets"), F.sum(asset_size()).alias("bytes"))
    out = wanted.withColumnRenamed("id", "book_id")
    for side in (by_author, by_tag, by_asset):
        out = out.join(side, "book_id", "left")
    return out.select(
        F.col("book_id").alias("id"), "title", "sort_title", "series", "series_index", "language", "publisher",
        "published_date", F.coalesce("authors", F.lit("")).alias("authors"),
        F.coalesce("genres", F.lit("")).alias("genres"), F.coalesce("tags", F.lit("")).alias("tags"),
        F.coalesce("n_assets", F.lit(0)).alias("n_assets"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def asset_size() -> Column:
    return F.coalesce(F.col("current_size"), F.col("original_size"), F.lit(0))


def publications(books: DataFrame, assets: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Live books that have at least one file."""
    files = assets.select(F.col("book_id").alias("id"))
    return live(books, visible).join(files, "id", "left_semi")


PUBLICATION_ORDERS = {
    "title": lambda: list_keys("title"),
    "recent": lambda: [Key(F.col("added_at"), desc=True), Key(F.col("id"), desc=True)],
}


def list_publications(books: DataFrame, assets: DataFrame, order: str, limit: int, offset: int = 0,
                      visible: DataFrame | None = None) -> DataFrame:
    return page(publications(books, assets, visible), PUBLICATION_ORDERS[order](), limit, offset).select("rn", *PUBLICATION)


def shelf_publications(books: DataFrame, assets: DataFrame, shelf_books: DataFrame, shelf_id: int,
                       visible: DataFrame | None = None) -> DataFrame:
    files = assets.select(F.col("book_id").alias("id"))
    return on_shelf(books, shelf_books, shelf_id, visible).join(files, "id", "left_semi")


def tag_publications(books: DataFrame, assets: DataFrame, tags: DataFrame, book_tags: DataFrame, name: str,
                     visible: DataFrame | None = None) -> DataFrame:
    """Books filed under a node of either kind or any node below it, each once."""
    branch = branch_members(tags, name)
    tagged = book_tags.join(branch, "tag_id", "left_semi").select(F.col("book_id").alias("id"))
    return publications(books, assets, visible).join(tagged, "id", "left_semi")


def branch_members(tags: DataFrame, name: str, kinds: tuple[str, ...] = ("genre", "tag")) -> DataFrame:
    key = tag_key(F.lit(name))
    return tags.where(F.col("kind").isin(*kinds) & F.array_contains(path_prefixes(F.col("name_key")), key)).select(
        F.col("id").alias("tag_id"))


def named_series(books: DataFrame, visible: DataFrame | None = None, q: str = "", after: str = "") -> DataFrame:
    rows = live(books, visible).where(~blank("series"))
    if q:
        rows = rows.where(F.contains(nocase("series"), nocase(F.lit(q))))
    if after:
        rows = rows.where(row_before([Key(nocase(F.lit(after))), Key(F.lit(after))], [nocase("series"), F.col("series")]))
    return rows


def series_counts(books: DataFrame, q: str = "", after: str = "", limit: int = 50,
                  visible: DataFrame | None = None) -> DataFrame:
    counts = named_series(books, visible, q, after).groupBy("series").agg(F.count(F.lit(1)).alias("book_count"))
    return page(counts, [Key(nocase("series")), Key(F.col("series"))], limit)


def series_cards(books: DataFrame, first_author: DataFrame, reading_state: DataFrame, user_id: int,
                 limit: int = 50, visible: DataFrame | None = None) -> DataFrame:
    """One tile per series: its first volume with a cover, its size, the viewer's finished count."""
    rows = named_series(books, visible)
    done = reading_state.where((F.col("user_id") == user_id) & (F.col("status") == "finished")).select(
        F.col("book_id").alias("id"), F.lit(1).alias("done"))
    keys = [Key(F.when(F.col("cover_version") > 0, 0).otherwise(1)), *volume_keys(), Key(F.col("id"))]
    order = F.struct(*[k.expr.alias(f"k{i}") for i, k in enumerate(keys)])
    tiles = (
        rows.join(done, "id", "left").groupBy("series").agg(
            F.count(F.lit(1)).alias("book_count"),
            F.sum(F.coalesce("done", F.lit(0))).cast("long").alias("finished_count"),
            F.min_by(F.struct("id", "cover_version"), order).alias("face"))
    )
    top = page(tiles, [Key(nocase("series")), Key(F.col("series"))], limit)
    faces = top.select("rn", "series", "book_count", "finished_count",
                       F.col("face.id").alias("cover_book_id"), F.col("face.cover_version").alias("cover_version"))
    names = first_author.select(F.col("book_id").alias("cover_book_id"), F.col("name").alias("author"))
    return faces.join(names, "cover_book_id", "left").withColumn("author", F.coalesce("author", F.lit("")))


def author_counts(books: DataFrame, authors: DataFrame, book_authors: DataFrame, limit: int = 50,
                  after: tuple[str, str] | None = None, visible: DataFrame | None = None) -> DataFrame:
    kept = live(books, visible).select(F.col("id").alias("book_id"))
    counts = (
        book_authors.join(kept, "book_id", "left_semi").groupBy("author_id").agg(F.count(F.lit(1)).alias("book_count"))
        .join(authors, F.col("author_id") == authors.id).select("name", "sort_name", "book_count")
    )
    keys = [Key(nocase("sort_name")), Key(F.col("name"))]
    if after:
        past = row_before([Key(nocase(F.lit(after[0]))), Key(F.lit(after[1]))], [k.expr for k in keys])
        counts = counts.where(past)
    return page(counts, keys, limit)


def author_info(books: DataFrame, authors: DataFrame, book_authors: DataFrame, name: str,
                visible: DataFrame | None = None) -> DataFrame:
    return author_counts(books, authors.where(F.col("name") == name), book_authors, 1, visible=visible).drop("rn")


def author_names(books: DataFrame, authors: DataFrame, book_authors: DataFrame, q: str, limit: int,
                 visible: DataFrame | None = None) -> DataFrame:
    kept = live(books, visible).select(F.col("id").alias("book_id"))
    used = book_authors.join(kept, "book_id", "left_semi").select(F.col("author_id").alias("id"))
    found = authors.where(F.contains(nocase("name"), nocase(F.lit(q)))).join(used, "id", "left_semi")
    return page(found, [Key(nocase("sort_name")), Key(F.col("name"))], limit).select("rn", "name", "sort_name")


def primary_author(authors: DataFrame, book_authors: DataFrame) -> DataFrame:
    """The lowest-ordered author of each book."""
    first = first_per(book_authors, ["book_id"], [Key(F.col("author_order")), Key(F.col("author_id"))], ["author_id"])
    return first.join(authors, F.col("author_id") == authors.id).select("book_id", "author_id", "name", "sort_name")


def tag_ancestry(tags: DataFrame) -> DataFrame:
    """(tag_id, ancestor_id, depth) for every node and itself, by path prefix instead of recursion."""
    nodes = tags.select("id", "kind", "name_key")
    steps = nodes.select(F.col("id").alias("tag_id"), "kind",
                         F.posexplode(path_prefixes(F.col("name_key"))).alias("depth", "name_key"))
    return steps.join(nodes, ["kind", "name_key"]).select(
        "tag_id", F.col("id").alias("ancestor_id"), F.col("depth").cast("long").alias("depth"))


def branch_counts(books: DataFrame, tags: DataFrame, book_tags: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(id, book_count, has_children) of every node with live books in its branch."""
    kept = live(books, visible).select(F.col("id").alias("book_id"))
    links = book_tags.join(kept, "book_id", "left_semi").select("book_id", "tag_id")
    rolled = links.join(tag_ancestry(tags), "tag_id")
    return rolled.groupBy(F.col("ancestor_id").alias("id")).agg(
        F.count_distinct("book_id").alias("book_count"),
        F.bool_or(F.col("ancestor_id") != F.col("tag_id")).alias("has_children"))


def tag_counts(books: DataFrame, tags: DataFrame, book_tags: DataFrame, kind: str, parent: str = "", q: str = "",
               sort: str = "name", after: tuple[str, int] | None = None, limit: int = 100,
               visible: DataFrame | None = None) -> DataFrame:
    """One page of nodes with branch sizes: roots, children of ``parent``, or a substring search."""
    nodes = tags.where(F.col("kind") == kind)
    if q:
        nodes = nodes.where(F.contains(F.col("name_key"), tag_key(F.lit(q))))
    elif parent:
        owner = tags.where((F.col("kind") == kind) & (F.col("name_key") == tag_key(F.lit(parent)))).select(
            F.col("id").alias("parent_id"))
        nodes = nodes.join(owner, "parent_id", "left_semi")
    else:
        nodes = nodes.where(F.col("parent_id").isNull())
    rows = nodes.join(branch_counts(books, tags, book_tags, visible), "id").select(
        "id", "name", "name_key", "book_count", "has_children")
    keys = [Key(F.col("name_key"))]
    if sort == "books":
        keys = [Key(F.col("book_count"), desc=True), *keys]
    if after:
        marks = [F.lit(after[1]), F.lit(after[0])] if sort == "books" else [F.lit(after[0])]
        rows = rows.where(row_before([Key(m, k.desc) for m, k in zip(marks, keys)], [k.expr for k in keys]))
    return page(rows, keys, limit)


def list_tags(books: DataFrame, tags: DataFrame, book_tags: DataFrame, kind: str, q: str = "",
              visible: DataFrame | None = None) -> DataFrame:
    """Names of nodes with live books at or below them."""
    nodes = tags.where(F.col("kind") == kind)
    if q:
        nodes = nodes.where(F.contains(F.col("name_key"), tag_key(F.lit(q))))
    kept = live(books, visible).select(F.col("id").alias("book_id"))
    used = book_tags.join(kept, "book_id", "left_semi").select("tag_id").distinct()
    reached = used.join(tag_ancestry(tags), "tag_id").select(F.col("ancestor_id").alias("id"))
    return nodes.join(reached, "id", "left_semi").select("name")


def tag_branch(tags: DataFrame, root: int) -> DataFrame:
    """A node and its descendants with their depth below it."""
    ancestry = tag_ancestry(tags)
    below = ancestry.where(F.col("ancestor_id") == root).select("tag_id")
    own_depth = ancestry.where(F.col("tag_id") == F.col("ancestor_id")).select("tag_id", F.col("depth").alias("level"))
    base = tags.where(F.col("id") == root).select(F.size(path_prefixes(F.col("name_key"))) - 1).scalar()
    return (
        tags.join(below, tags.id == below.tag_id, "left_semi").join(own_depth, F.col("id") == F.col("tag_id"))
        .select("id", "name", "kind", (F.col("level") - base).cast("long").alias("depth"))
    )


def list_shelves(users: DataFrame, shelves: DataFrame, scope_shelves: DataFrame, user_id: int) -> DataFrame:
    """Shelves one account sees: shared and own ones; a scoped reader only its assigned shared ones."""
    scoped = users.where(F.col("id") == user_id).select(
        ((F.col("role") == "reader") & (F.col("content_scope") == "shelves")).alias("scoped")).limit(1).scalar()
    assigned = scope_shelves.where(F.col("user_id") == user_id).select(
        F.col("shelf_id").alias("id"), F.lit(True).alias("assigned")).distinct()
    shared = F.col("visibility") == "shared"
    own = F.col("owner_id") == user_id
    rows = shelves.where(shared | own).join(assigned, "id", "left").withColumn("scoped", scoped)
    limited = F.when(shared, F.col("assigned").isNotNull()).otherwise(own)
    return rows.where(F.when(F.col("scoped"), limited).otherwise(F.lit(True))).select(
        F.col("id").alias("shelf_id"), "name", "kind", "visibility", "position")


def shelf_order() -> list[Key]:
    return [Key(F.col("visibility") != "shared"), Key(F.col("position")), Key(nocase("name")), Key(F.col("shelf_id"))]


def shelf_memberships(shelves: DataFrame, shelf_books: DataFrame, viewer: int, book_id: int) -> DataFrame:
    """Visible manual shelves with a flag telling whether the book is on each."""
    seen = shelves.where((F.col("kind") == "manual") & ((F.col("visibility") == "shared") | (F.col("owner_id") == viewer)))
    on = shelf_books.where(F.col("book_id") == book_id).select(F.col("shelf_id").alias("id"), F.lit(True).alias("on"))
    return seen.join(on, "id", "left").select("id", "name", "visibility", "position", F.col("on").isNotNull().alias("in_shelf"))


def continue_reading(books: DataFrame, assets: DataFrame, positions: DataFrame, reading_state: DataFrame,
                     user_id: int, limit: int = 8, visible: DataFrame | None = None) -> DataFrame:
    """Latest unfinished position of each book the user is reading, newest first."""
    mine = positions.where((F.col("user_id") == user_id) & (F.col("updated_at") > 0) & (F.col("progress") < FINISHED_AT))
    reading = reading_state.where((F.col("user_id") == user_id) & (F.col("status") == "reading")).select("book_id")
    placed = mine.join(assets.select(F.col("id").alias("asset_id"), "book_id"), "asset_id").join(reading, "book_id", "left_semi")
    latest = first_per(placed, ["book_id"], [Key(-F.col("updated_at")), Key(F.col("asset_id"))],
                       ["asset_id", "progress", "updated_at"])
    rows = live(books, visible).select(*SUMMARY).join(latest, F.col("id") == F.col("book_id")).drop("book_id")
    return page(rows, [Key(F.col("updated_at"), desc=True), Key(F.col("id"))], limit)


def trash_listing(books: DataFrame, users: DataFrame, limit: int | None = None, visible: DataFrame | None = None) -> DataFrame:
    """Trashed books, latest first, with who trashed them."""
    gone = within(books.where(F.col("deleted_at").isNotNull()), visible)
    who = users.select(F.col("id").alias("deleted_by"), F.col("username").alias("deleted_by_name"))
    named = gone.join(who, "deleted_by", "left").withColumn("deleted_by_name", F.coalesce("deleted_by_name", F.lit("")))
    return page(named, [Key(F.col("deleted_at"), desc=True), Key(F.col("id"))], limit).select(
        "rn", "id", "title", "deleted_at", "deleted_by_name")


def trashed_ids(books: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    gone = books.where(F.col("deleted_at").isNotNull()).select("id")
    return gone if ids is None else gone.join(ids, "id", "left_semi")


def trashed_assets(books: DataFrame, assets: DataFrame) -> DataFrame:
    gone = trashed_ids(books).withColumnRenamed("id", "book_id")
    return assets.join(gone, "book_id", "left_semi").select("book_id", "id", "format", "storage_path", asset_size().alias("bytes"))


def storage_stats(books: DataFrame, assets: DataFrame) -> DataFrame:
    kept = live(books).select(F.col("id").alias("book_id"))
    size = assets.join(kept, "book_id", "left_semi").agg(F.coalesce(F.sum(asset_size()), F.lit(0)).alias("bytes"))
    return kept.agg(F.count(F.lit(1)).alias("books")).withColumn("bytes", size.scalar())


def cleanup_counts(books: DataFrame, book_authors: DataFrame, book_tags: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Live books lacking a cover, an author, any genre or tag, or a description."""
    has_author = book_authors.select(F.col("book_id").alias("id")).distinct().withColumn("has_author", F.lit(True))
    has_tag = book_tags.select(F.col("book_id").alias("id")).distinct().withColumn("has_tag", F.lit(True))
    rows = live(books, visible).select("id", "cover_version", "description").join(has_author, "id", "left").join(has_tag, "id", "left")
    return rows.agg(
        F.count_if(F.col("cover_version") <= 0).alias("missing_cover"),
        F.count_if(F.col("has_author").isNull()).alias("missing_author"),
        F.count_if(F.col("has_tag").isNull()).alias("no_genres_or_tags"),
        F.count_if(F.col("description").isNull() | (F.col("description") == "")).alias("no_description"))


def list_annotations(annotations: DataFrame, user_id: int, by: str, target: int, limit: int | None = None) -> DataFrame:
    """Live annotations of one asset or one book (``by``), in creation order."""
    rows = annotations.where((F.col("user_id") == user_id) & (F.col(by) == target) & (F.col("deleted") == 0))
    lead = [Key(F.col("asset_id"))] if by == "book_id" else []
    return page(rows, [*lead, Key(F.col("created_at")), Key(F.col("id"))], limit)
