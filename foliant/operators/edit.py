"""Catalogue edits as snapshot transforms: tables in, changed rows or new tables out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.formats import WRITABLE
from foliant.functions.ordering import Key, number_rows, page, running_sum
from foliant.functions.paths import render_book_path
from foliant.functions.people import format_author_list
from foliant.functions.tagging import path_prefixes, tag_key, tag_parts
from foliant.functions.text import strip
from foliant.operators.dedupe import preferred_primary
from foliant.operators.records import merge_overrides
from foliant.session import cut_lineage

# --- authors -------------------------------------------------------------------------


def upsert_book_authors(edits: DataFrame, authors: DataFrame) -> DataFrame:
    """Ordered links after replacing the authors of the edited books.

    ``edits`` is (book_id, idx, name, sort_name). The first use of an exact
    name in a book wins, known authors keep their stored sort name, and new
    ones take the sort name of their first use; new ids continue after the
    largest known one.
    """
    once = edits.groupBy("book_id", "name").agg(F.min("idx").alias("idx"), F.min_by("sort_name", "idx").alias("sort_name"))
    placed = running_sum(once, ["book_id"], [Key(F.col("idx"))], F.floor(F.col("idx") / 4096), F.lit(1), "author_order")
    known = authors.select("name", F.col("id").alias("known_id"), F.col("sort_name").alias("known_sort"))
    fresh = once.join(known, "name", "left_anti").groupBy("name").agg(
        F.min_by("sort_name", F.struct("book_id", "idx")).alias("new_sort"))
    last = authors.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = number_rows(fresh, [Key(F.col("name"))], "step").withColumn("new_id", F.col("step") + last).drop("step")
    linked = placed.join(known, "name", "left").join(numbered, "name", "left")
    return linked.select("book_id", F.coalesce("known_id", "new_id").alias("author_id"), "name",
                         F.coalesce("known_sort", "new_sort").alias("sort_name"), F.col("author_order").cast("long").alias("author_order"))


def primary_sort(links: DataFrame) -> DataFrame:
    """(book_id, primary_author_sort) from ordered links carrying sort names."""
    return links.groupBy("book_id").agg(F.min_by("sort_name", F.struct("author_order", "author_id")).alias("primary_author_sort"))


def rename_authors(renames: DataFrame, authors: DataFrame, book_authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authors, links) after renaming: an existing new name absorbs the old author's links.

    ``renames`` is (old_name, new_name, new_sort); a link a book already has to
    the target is kept, and the moved duplicate dropped.
    """
    wanted = renames.where(F.col("old_name") != F.col("new_name"))
    target = authors.select(F.col("name").alias("new_name"), F.col("id").alias("target_id"))
    moves = wanted.join(authors.select(F.col("name").alias("old_name"), F.col("id").alias("old_id")), "old_name").join(target, "new_name", "left")
    named = moves.where("target_id IS NULL").select(F.col("old_id").alias("id"), "new_name", "new_sort")
    absorbed = moves.where("target_id IS NOT NULL").select(F.col("old_id").alias("author_id"), "target_id")
    people = (
        authors.join(absorbed.select(F.col("author_id").alias("id")), "id", "left_anti").join(named, "id", "left")
        .select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_sort", "sort_name").alias("sort_name"))
    )
    moved = book_authors.join(absorbed, "author_id", "left")
    links = moved.groupBy("book_id", F.coalesce("target_id", "author_id").alias("author_id")).agg(
        F.min_by("author_order", F.struct(F.col("target_id").isNotNull(), F.col("author_order"))).alias("author_order"))
    return people, links


def set_author_sort(authors: DataFrame, book_authors: DataFrame, name: str, sort_name: str) -> DataFrame:
    """Books affected by giving an author another sort name."""
    changed = authors.where((F.col("name") == name) & (F.col("sort_name") != sort_name)).select(F.col("id").alias("author_id"))
    return book_authors.join(changed, "author_id", "left_semi").select("book_id").distinct()


def orphan_authors(authors: DataFrame, book_authors: DataFrame) -> DataFrame:
    return authors.join(book_authors.select(F.col("author_id").alias("id")), "id", "left_anti")


# --- tags ----------------------------------------------------------------------------


def used_paths(tags: DataFrame, book_tags: DataFrame) -> DataFrame:
    """(kind, name_key) of every node with a book at or below it."""
    used = tags.join(book_tags.select(F.col("tag_id").alias("id")).distinct(), "id", "left_semi")
    return used.select("kind", F.explode(path_prefixes(F.col("name_key"))).alias("name_key")).distinct()


def orphan_tags(tags: DataFrame, book_tags: DataFrame) -> DataFrame:
    """Nodes with no book at or below them."""
    return tags.join(used_paths(tags, book_tags), ["kind", "name_key"], "left_anti")


def respell_paths(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, name_key, name, is_new) for every level of the wanted paths.

    ``wanted`` is (kind, name, first) where ``first`` orders who creates a
    shared level. Known nodes keep their spelling, and the levels below them
    take it over.
    """
    levels = wanted.withColumn("parts", tag_parts(F.col("name"))).select(
        "kind", "first", "parts", F.posexplode("parts").alias("depth", "part"))
    levels = levels.select("kind", "first", "depth", "part", F.lower(F.array_join(F.slice("parts", F.lit(1), F.col("depth") + 1), ".")).alias("name_key"))
    chosen = levels.groupBy("kind", "name_key").agg(F.min_by("part", "first").alias("part"), F.max("depth").alias("depth"))
    known = nodes.select("kind", F.col("name_key").alias("lead"), F.col("name").alias("known_name"))
    parts = chosen.select("kind", F.col("name_key").alias("lead"), F.col("part").alias("lead_part"))
    spread = chosen.select("kind", "name_key", F.posexplode(path_prefixes(F.col("name_key"))).alias("at", "lead"))
    joined = spread.join(known, ["kind", "lead"], "left").join(parts, ["kind", "lead"])
    # At most 16 levels per path.
    built = joined.groupBy("kind", "name_key").agg(
        F.max_by("known_name", F.when(F.col("known_name").isNotNull(), F.col("at"))).alias("base"),
        F.coalesce(F.max(F.when(F.col("known_name").isNotNull(), F.col("at"))), F.lit(-1)).alias("base_at"),
        F.max("at").alias("own_at"), F.array_sort(F.collect_list(F.struct("at", "lead_part"))).alias("steps"))
    rest = F.transform(F.filter("steps", lambda s: s["at"] > F.col("base_at")), lambda s: s["lead_part"])
    name = F.array_join(F.concat(F.when(F.col("base").isNotNull(), F.array("base")).otherwise(F.array().cast("array<string>")), rest), ".")
    return built.select("kind", "name_key", name.alias("name"), (F.col("base_at") < F.col("own_at")).alias("is_new"))


def set_book_tags(edits: DataFrame, kind: str, tags: DataFrame, book_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, links) after replacing one kind of tags on the edited books.

    ``edits`` is (book_id, idx, name), names unique per book; links name their
    node by (kind, name_key). The other kind and all other books are untouched.
    """
    wanted = edits.select(F.lit(kind).alias("kind"), "name", F.struct("book_id", "idx").alias("first"))
    nodes = respell_paths(wanted, tags.where(F.col("kind") == kind)).where("is_new").select("kind", "name_key", "name")
    current = book_tags.join(tags.select(F.col("id").alias("tag_id"), "kind", "name_key"), "tag_id")
    edited = edits.select("book_id", F.lit(kind).alias("kind")).distinct()
    kept = current.join(edited, ["book_id", "kind"], "left_anti").select("book_id", "kind", "name_key", "position")
    placed = running_sum(edits, ["book_id"], [Key(F.col("idx"))], F.floor(F.col("idx") / 4096), F.lit(1), "position")
    links = placed.select("book_id", F.lit(kind).alias("kind"), tag_key(F.col("name")).alias("name_key"), F.col("position").cast("long"))
    return nodes, kept.unionByName(links)


def rename_tag(tags: DataFrame, book_tags: DataFrame, tag_id: int, new_name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) after moving a whole branch; overlapping nodes merge, keeping each book's first position."""
    root = tags.where(F.col("id") == tag_id).select("kind", "name").first()
    if root is None:
        raise LookupError("tag not found")
    parts = [p.strip() for p in new_name.split(".")]
    new_name = ".".join(parts) if len(parts) <= 16 and all(parts) else new_name.strip()
    old_key, new_key = root.name.lower(), new_name.lower()
    if all(parts) and len(parts) > 1 and new_key.startswith(old_key + "."):
        raise ValueError("a branch cannot be moved inside itself")
    in_branch = (F.col("kind") == root.kind) & ((F.col("name_key") == old_key) | F.col("name_key").startswith(old_key + "."))
    moved_name = F.concat(F.lit(new_name), F.substr("name", F.lit(len(root.name) + 1)))
    branch = tags.where(in_branch).select("id", "kind", "name_key", moved_name.alias("name"))
    too_deep = branch.where((F.col("name_key") != old_key) & (F.size(tag_parts(F.col("name"))) == 1))
    if too_deep.limit(1).count():
        raise ValueError("use a path with non-empty parts and at most 16 levels")
    outside = tags.where(~in_branch)
    wanted = branch.select("kind", "name", F.col("name_key").alias("first"))
    fresh = respell_paths(wanted, outside).select("kind", "name_key", "name", F.lit(True).alias("fresh"))
    nodes = outside.select("kind", "name_key", "name").join(fresh.where("fresh").select("kind", "name_key"), ["kind", "name_key"], "left_anti").unionByName(
        fresh.select("kind", "name_key", "name"))
    target = outside.select("id", "kind", "name_key").unionByName(branch.select("id", "kind", tag_key(F.col("name")).alias("name_key")))
    links = book_tags.join(target, F.col("tag_id") == F.col("id")).groupBy("book_id", "kind", "name_key").agg(F.min("position").alias("position"))
    used = links.select("kind", F.explode(path_prefixes(F.col("name_key"))).alias("name_key")).distinct()
    return nodes.join(used, ["kind", "name_key"], "left_semi"), links


def delete_tag(tags: DataFrame, book_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    """(tags, links) without a branch and without the nodes that become unused."""
    root = tags.where(F.col("id") == tag_id).select("kind", "name_key").first()
    if root is None:
        raise LookupError("tag not found")
    name = F.col("name_key")
    gone = tags.where((F.col("kind") == root.kind) & ((name == root.name_key) | name.startswith(root.name_key + "."))).select("id")
    links = book_tags.join(gone.select(F.col("id").alias("tag_id")), "tag_id", "left_anti")
    rest = tags.join(gone, "id", "left_anti")
    return rest.join(used_paths(rest, links), ["kind", "name_key"], "left_semi"), links


# --- bulk edit -----------------------------------------------------------------------


@dataclass
class BulkEdit:
    """One prepared bulk operation: tag modes, an author list, a series change."""

    genres: tuple[str, list[str]] | None = None
    tags: tuple[str, list[str]] | None = None
    authors: list[str] | None = None
    series: str | None = None
    clear_series: bool = False
    index_mode: str = "keep"
    index_start: float = 1.0
    index_step: float = 1.0


def _index(value: Column) -> Column:
    return F.when(value > 0, value)


def plain_key(name: str) -> str:
    """The tag key of a prepared value, on the driver."""
    parts = [p.strip() for p in name.strip().split(".")]
    return (".".join(parts) if len(parts) <= 16 and all(parts) else name.strip()).lower()


def edit_list(names: Column, keys: Column, op: tuple[str, list[str]] | None) -> tuple[Column, Column]:
    """(new names, changed) of one tag operation; ``keys`` runs parallel to ``names``."""
    if op is None:
        return names, F.lit(False)
    mode, values = op
    by_key = {plain_key(v): v for v in reversed(values)}
    wanted = [(key, by_key[key]) for key in dict.fromkeys(plain_key(v) for v in values)]
    if mode == "clear":
        return F.array().cast("array<string>"), F.size(names) > 0
    if mode == "replace":
        return F.array(*[F.lit(v) for v in values]), keys != F.array(*[F.lit(plain_key(v)) for v in values])
    held = [F.array_contains(keys, key) for key, _ in wanted]
    if mode == "add":
        missing = F.array_compact(F.array(*[F.when(~has, F.lit(value)) for has, (_, value) in zip(held, wanted)]))
        return F.concat(names, missing), ~reduce(lambda a, b: a & b, held)
    dropped = [key for key, _ in wanted]
    return F.filter(names, lambda n, i: ~F.get(keys, i).isin(*dropped)), reduce(lambda a, b: a | b, held)


def bulk_edit(selection: DataFrame, rows: DataFrame, edit: BulkEdit) -> DataFrame:
    """Changed rows of a bulk operation with their override marks and relayout flag.

    ``selection`` is (id, pos) in the order shown to the user; ``rows`` is
    (id, genres, genre_keys, tags, tag_keys, authors, series, series_index,
    manual_overrides) of the live visible books, the lists in their order.
    """
    book = rows.join(selection, "id")
    genres, genres_changed = edit_list(F.col("genres"), F.col("genre_keys"), edit.genres)
    tags, tags_changed = edit_list(F.col("tags"), F.col("tag_keys"), edit.tags)
    authors, authors_changed = F.lit(None).cast("string"), F.lit(False)
    if edit.authors is not None:
        text = "; ".join(a.strip().replace("&", "&&") for a in edit.authors if a.strip())
        authors, authors_changed = F.lit(text), format_author_list(F.col("authors")) != text
    series, index = strip(F.coalesce("series", F.lit(""))), _index(F.col("series_index"))
    new_series, new_index = series, index
    if edit.clear_series:
        new_series, new_index = F.lit(""), F.lit(None).cast("double")
    elif edit.series is not None:
        new_series = F.lit(edit.series.strip())
        if edit.index_mode == "clear":
            new_index = F.lit(None).cast("double")
        elif edit.index_mode == "assign":
            new_index = _index(edit.index_start + edit.index_step * F.col("pos"))
    changed = {"genres": genres_changed, "tags": tags_changed, "series": new_series != series,
               "series_index": ~new_index.eqNullSafe(index), "authors": authors_changed}
    marked = book.select(
        "id", "manual_overrides", genres.alias("genres"), tags.alias("tags"),
        F.when(new_series != "", new_series).alias("series"), new_index.alias("series_index"),
        F.when(authors_changed, authors).alias("authors"),
        F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in changed.items()])).alias("edited"))
    return marked.where(F.size("edited") > 0).select(
        "id", "genres", "tags", "series", "series_index", "authors",
        merge_overrides(F.col("manual_overrides"), F.col("edited")).alias("overrides"),
        F.arrays_overlap("edited", F.array(F.lit("series"), F.lit("series_index"), F.lit("authors"))).alias("relayout"))


# --- trash, shelves, files -----------------------------------------------------------


def soft_delete(books: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Books after trashing the requested live ones; ``requests`` is (id, user_id)."""
    asked = requests.groupBy("id").agg(F.min("user_id").alias("by"))
    hit = F.col("by").isNotNull() & F.col("deleted_at").isNull()
    return books.join(asked, "id", "left").select(
        "id", F.when(hit, F.lit(now)).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(hit, F.col("by")).otherwise(F.col("deleted_by")).alias("deleted_by"), hit.alias("changed"))


def restore(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Books after taking the requested trashed ones out of the trash."""
    asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
    hit = F.col("asked").isNotNull() & F.col("deleted_at").isNotNull()
    gone = F.lit(None).cast("long")
    return books.join(asked, "id", "left").select(
        "id", F.when(hit, gone).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(hit, gone).otherwise(F.col("deleted_by")).alias("deleted_by"), hit.alias("changed"))


def purge(books: DataFrame, children: dict[str, DataFrame], ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Books and child tables without the trashed books (of ``ids``, if given)."""
    gone = books.where(F.col("deleted_at").isNotNull()).select("id")
    gone = gone if ids is None else gone.join(ids, "id", "left_semi")
    left = {"books": books.join(gone, "id", "left_anti")}
    key = gone.select(F.col("id").alias("book_id"))
    left.update({name: table.join(key, "book_id", "left_anti") for name, table in children.items()})
    return left


def choose_primary_assets(assets: DataFrame) -> DataFrame:
    """Default file of every book and whether that is a change."""
    return preferred_primary(assets).join(assets.select("id", "is_primary", "format"), "id").select(
        "book_id", F.col("id").alias("asset_id"), "format", (~F.col("is_primary")).alias("promoted"))


def shelf_add(shelf_books: DataFrame, requests: DataFrame) -> DataFrame:
    """New shelf rows appended after the last position, in request order; present books are skipped.

    ``requests`` is (shelf_id, idx, book_id).
    """
    asked = requests.groupBy("shelf_id", "book_id").agg(F.min("idx").alias("idx"))
    fresh = asked.join(shelf_books.select("shelf_id", "book_id"), ["shelf_id", "book_id"], "left_anti")
    placed = running_sum(fresh, ["shelf_id"], [Key(F.col("idx")), Key(F.col("book_id"))], F.floor(F.col("idx") / 4096), F.lit(1), "step")
    ends = shelf_books.groupBy("shelf_id").agg((F.max("position") + 1).alias("base"))
    return placed.join(ends, "shelf_id", "left").select(
        "shelf_id", "book_id", (F.coalesce("base", F.lit(0)) + F.col("step")).cast("long").alias("position"))


def shelf_remove(shelf_books: DataFrame, requests: DataFrame) -> DataFrame:
    """Shelf rows left after removing the requested (shelf_id, book_id) pairs."""
    return shelf_books.join(requests.select("shelf_id", "book_id"), ["shelf_id", "book_id"], "left_anti")


def writable_assets(assets: DataFrame, books: DataFrame) -> DataFrame:
    """Live files that can carry metadata, with their book's revision and lag flags."""
    revs = books.where(F.col("deleted_at").isNull()).select(F.col("id").alias("book_id"), "metadata_rev")
    rows = assets.where(F.col("format").isin(*WRITABLE)).join(revs, "book_id")
    return rows.withColumn("dirty", F.col("writeback_rev") < F.col("metadata_rev")).withColumn(
        "failed", F.col("dirty") & (F.coalesce("writeback_error", F.lit("")) != ""))


def writeback_counts(assets: DataFrame, books: DataFrame) -> DataFrame:
    return writable_assets(assets, books).agg(F.count_if("dirty").alias("dirty"), F.count_if("failed").alias("failed"))


def writeback_book_state(assets: DataFrame, books: DataFrame) -> DataFrame:
    return writable_assets(assets, books).groupBy("book_id").agg(F.count(F.lit(1)).alias("writable"), F.count_if("dirty").alias("dirty"))


def writeback_backlog(assets: DataFrame, books: DataFrame, mode: str, limit: int, failed_before: int = 0) -> DataFrame:
    """An ordered batch: dirty, failed, all, or automatic (failed ones only once old enough)."""
    keep = {"dirty": F.col("dirty"), "failed": F.col("failed"), "all": F.lit(True),
            "automatic": F.col("dirty") & (~F.col("failed") | (F.col("updated_at") <= failed_before))}[mode]
    return page(writable_assets(assets, books).where(keep), [Key(F.col("id"))], limit).select(
        "rn", "id", "book_id", "format", "metadata_rev", "writeback_rev", "failed")


def record_asset_bytes(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """Files after new bytes: acknowledgement and sampled hash survive only if the bytes are the same.

    ``updates`` is (id, hash, size, metadata_rev); a null revision means a
    restore, which keeps the acknowledged revision of equal bytes.
    """
    same = F.col("current_hash").eqNullSafe(F.col("hash"))
    return assets.join(updates, "id").select(
        "id", F.col("hash").alias("current_hash"), F.col("size").alias("current_size"),
        F.when(same, F.col("sampled_hash")).alias("sampled_hash"),
        F.coalesce("metadata_rev", F.when(same, F.col("writeback_rev")).otherwise(F.lit(0))).alias("writeback_rev"))


# --- layout and integrity ------------------------------------------------------------


def relayout_plan(files: DataFrame, template: str, columns: dict[str, Column]) -> DataFrame:
    """(asset_id, old_path, new_path, collides) for files whose rendered path differs or clashes.

    The rendered paths are counted and then compared, so they are written once.
    """
    rendered = cut_lineage(files.select(
        "asset_id", F.col("storage_path").alias("old_path"), render_book_path(template, columns).alias("new_path")))
    shared = rendered.where("new_path IS NOT NULL").groupBy("new_path").agg(F.count(F.lit(1)).alias("users")).where("users > 1")
    marked = rendered.join(shared, "new_path", "left").withColumn("collides", F.col("users").isNotNull())
    return marked.where("new_path IS NULL OR new_path <> old_path OR collides").select("asset_id", "old_path", "new_path", "collides")


def reconcile_storage(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Integrity findings (kind, path, asset_id) of the catalogue against a file inventory.

    ``files`` is (path, size, hash, format); a null hash or format was not
    inspected. Sizes are compared first and hashes only where sizes agree.
    """
    wanted = assets.select(F.col("id").alias("asset_id"), F.col("storage_path").alias("path"), "current_size", "current_hash",
                           F.col("format").alias("want_format"))
    both = wanted.join(files.withColumn("on_disk", F.lit(True)), "path", "full_outer")
    known, found = F.col("asset_id").isNotNull(), F.col("on_disk").isNotNull()
    fits = F.coalesce(F.col("current_size") == F.col("size"), F.lit(False))
    checks = {
        "missing_file": known & ~found, "orphan_file": ~known,
        "missing_size": known & found & F.col("current_size").isNull(),
        "size_mismatch": known & found & (F.col("current_size") != F.col("size")),
        "hash_mismatch": known & found & fits & (F.col("current_hash") != F.col("hash")),
        "format_mismatch": known & found & (F.col("want_format") != F.col("format")),
    }
    kinds = F.filter(F.array(*[F.when(cond, F.lit(kind)) for kind, cond in checks.items()]), lambda k: k.isNotNull())
    return both.select(F.explode(kinds).alias("kind"), "path", "asset_id")


def page_count_backfill(assets: DataFrame, books: DataFrame, measured: DataFrame) -> DataFrame:
    """Fill missing page counts of live books, only for the very bytes that were measured.

    ``measured`` is (asset_id, hash, pages).
    """
    alive = books.where(F.col("deleted_at").isNull()).select(F.col("id").alias("book_id"), F.lit(True).alias("alive"))
    counts = measured.where("pages > 0").select(F.col("asset_id").alias("id"), F.col("hash").alias("current_hash"), "pages").dropDuplicates(["id", "current_hash"])
    rows = assets.select("id", "book_id", "current_hash", "page_count").join(counts, ["id", "current_hash"], "left").join(alive, "book_id", "left")
    fill = F.when(F.col("alive"), F.col("pages"))
    return rows.select("id", F.coalesce("page_count", fill).alias("page_count"), (F.col("page_count").isNull() & fill.isNotNull()).alias("changed"))
