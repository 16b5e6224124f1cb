"""Duplicate books: detection, dismissals, checked merges of books and reading state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.formats import reading_priority
from foliant.functions.ordering import Key, page
from foliant.functions.text import squeeze, strip
from foliant.operators.browse import live

REASON = "title_author"


def _key_part(text: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(text, r"[^\p{L}\p{Nd}\s\u0085\p{Z}]", "")))


def duplicate_key(title: Column, author: Column) -> Column:
    """Letters and digits in lower case with single spaces; accents are kept apart."""
    return F.concat(_key_part(title), F.lit("|"), _key_part(author))


def keyed_books(books: DataFrame, first_author: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Live visible books with their duplicate key."""
    names = first_author.select(F.col("book_id").alias("id"), F.col("name").alias("author"))
    return live(books, visible).join(names, "id", "left").withColumn(
        "key", duplicate_key(F.col("title"), F.coalesce("author", F.lit(""))))


def duplicate_groups(keyed: DataFrame) -> DataFrame:
    """(key, size, newest, first_id) of keys shared by two or more books.

    Groups stay counts: members are found by joining back on the key, so a
    group of copies of any size never sits in one row.
    """
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("added_at").alias("newest"),
                                    F.min("id").alias("first_id")).where("size >= 2")


def group_members(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    return keyed.join(groups.select("key", "size"), "key").select("key", "id", "size")


def apply_dismissals(keyed: DataFrame, groups: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Drop a group if one dismissal of its reason and key contains every current member.

    ``dismissals`` has one row per dismissed book: (dismissal_id, reason, key, book_id).
    """
    named = dismissals.where(F.col("reason") == REASON).select("dismissal_id", "key", F.col("book_id").alias("id")).distinct()
    covered = group_members(keyed, groups).join(named, ["key", "id"]).groupBy("key", "dismissal_id").agg(
        F.count(F.lit(1)).alias("covered"), F.max("size").alias("size")).where("covered = size")
    return groups.join(covered.select("key"), "key", "left_anti")


def duplicate_page(groups: DataFrame, limit: int) -> DataFrame:
    """The newest groups, numbered, with the number of all groups."""
    total = groups.agg(F.count(F.lit(1))).scalar()
    return page(groups, [Key(F.col("newest"), desc=True), Key(F.col("first_id"))], limit).withColumn("total", total)


def validate_duplicate_set(requests: DataFrame, keyed: DataFrame) -> DataFrame:
    """(request_id, valid): two or more distinct live visible books sharing one key, the survivor among them.

    ``requests`` has one row per named book: (request_id, survivor_id, book_id).
    """
    asked = requests.where(F.col("book_id") > 0).select("request_id", "survivor_id", "book_id").distinct()
    state = keyed.select(F.col("id").alias("book_id"), "key", F.lit(1).alias("found"))
    checks = asked.join(state, "book_id", "left").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("asked"), F.count("found").alias("found"),
        F.min("key").alias("low"), F.max("key").alias("high"),
        F.bool_or((F.col("survivor_id") == 0) | (F.col("survivor_id") == F.col("book_id"))).alias("has_survivor"))
    valid = (F.col("asked") >= 2) & (F.col("found") == F.col("asked")) & (F.col("low") == F.col("high")) & F.col("has_survivor")
    every = requests.select("request_id").distinct()
    return every.join(checks.select("request_id", valid.alias("valid")), "request_id", "left").select(
        "request_id", F.coalesce("valid", F.lit(False)).alias("valid"))


def merge_plan(requests: DataFrame, keyed: DataFrame) -> DataFrame:
    """(survivor_id, book_id, place) of the losers of all valid requests, in request order."""
    ok = validate_duplicate_set(requests, keyed).where("valid").select("request_id")
    rows = requests.join(ok, "request_id", "left_semi").where(F.col("book_id") != F.col("survivor_id"))
    return rows.groupBy("survivor_id", "book_id").agg(F.min("place").alias("place"))


def merge_books(books: DataFrame, plan: DataFrame, now: int, fill_covers: bool = True) -> DataFrame:
    """Changed books: survivors take a missing description or cover from the first donor, losers go to the trash."""
    donors = plan.join(books.select(F.col("id").alias("book_id"), strip(F.coalesce("description", F.lit(""))).alias("text"),
                                    F.col("cover_version").alias("donor_cover")), "book_id")
    order = F.struct("place", "book_id")
    gifts = donors.groupBy(F.col("survivor_id").alias("id")).agg(
        F.min_by("text", F.when(F.col("text") != "", order)).alias("text"),
        F.min_by("book_id", F.when(F.col("donor_cover") > 0, order)).alias("cover_from"))
    bare = strip(F.coalesce("description", F.lit(""))) == ""
    fills_cover = F.lit(fill_covers) & (F.col("cover_version") <= 0) & F.col("cover_from").isNotNull()
    kept = books.join(gifts, "id").select(
        "id", F.when(bare & F.col("text").isNotNull(), F.col("text")).otherwise(F.col("description")).alias("description"),
        F.when(fills_cover, F.col("cover_version") + 1).otherwise(F.col("cover_version")).alias("cover_version"),
        F.when(fills_cover, F.col("cover_from")).alias("cover_from"), F.lit(None).cast("long").alias("deleted_at"))
    lost = books.join(plan.select(F.col("book_id").alias("id")), "id", "left_semi").select(
        "id", "description", "cover_version", F.lit(None).cast("long").alias("cover_from"), F.lit(now).cast("long").alias("deleted_at"))
    return kept.unionByName(lost)


def preferred_primary(assets: DataFrame) -> DataFrame:
    """(book_id, id) of each book's default file: best reading format, then the current one, oldest, lowest id."""
    order = F.struct(reading_priority(F.col("format")), ~F.col("is_primary"), F.col("created_at"), F.col("id"))
    return assets.groupBy("book_id").agg(F.min_by("id", order).alias("id"))


def merge_assets(assets: DataFrame, plan: DataFrame) -> DataFrame:
    """Files of the merged books on their survivor, with the default file chosen anew.

    Acknowledged revisions of moved files are forgotten: they belonged to another book.
    """
    target = plan.select("book_id", "survivor_id")
    moved = assets.join(target, "book_id").withColumn("book_id", F.col("survivor_id")).withColumn(
        "is_primary", F.lit(False)).withColumn("writeback_rev", F.lit(0).cast("long")).drop("survivor_id")
    own = assets.join(plan.select(F.col("survivor_id").alias("book_id")), "book_id", "left_semi")
    together = own.unionByName(moved.select(*own.columns)).select("id", "book_id", "format", "is_primary", "created_at", "writeback_rev")
    best = preferred_primary(together).select("book_id", F.col("id").alias("best"))
    return together.join(best, "book_id").select("id", "book_id", (F.col("id") == F.col("best")).alias("is_primary"), "writeback_rev")


def merge_shelves(shelf_books: DataFrame, plan: DataFrame) -> DataFrame:
    """All shelf rows after the merge; a survivor's own row wins, then the lowest loser's."""
    target = plan.select("book_id", "survivor_id")
    rows = shelf_books.join(target, "book_id", "left").select(
        "shelf_id", F.coalesce("survivor_id", "book_id").alias("target"), "book_id", "position", "added_at",
        F.col("survivor_id").isNotNull().alias("moved"))
    return rows.groupBy("shelf_id", F.col("target").alias("book_id")).agg(
        F.min_by(F.struct("position", "added_at"), F.struct("moved", "book_id")).alias("r")).select(
        "shelf_id", "book_id", "r.position", "r.added_at")


def merge_reading_state(reading_state: DataFrame, plan: DataFrame) -> DataFrame:
    """One state per user and survivor: the newest, ties to the survivor, then to the lower id."""
    members = plan.select("survivor_id", "book_id").unionByName(
        plan.select("survivor_id", F.col("survivor_id").alias("book_id"))).distinct()
    rows = reading_state.join(members, "book_id")
    rank = F.struct(F.col("updated_at"), F.col("book_id") == F.col("survivor_id"), -F.col("book_id"))
    return rows.groupBy("user_id", "survivor_id").agg(
        F.max_by(F.struct("status", "last_event_id", "updated_at"), rank).alias("s")).select(
        "user_id", F.col("survivor_id").alias("book_id"), "s.status", "s.last_event_id", "s.updated_at")
