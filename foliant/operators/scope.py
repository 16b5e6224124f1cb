"""Row-level visibility: which books an account may see."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut_lineage, if_small, written


def scoped_readers(users: DataFrame) -> DataFrame:
    """Accounts limited to their assigned shelves; every other account sees the whole catalogue."""
    limited = (F.col("role") == "reader") & (F.col("content_scope") == "shelves")
    return users.where(limited).select(F.col("id").alias("user_id"))


def scope_shelves(users: DataFrame, shelves: DataFrame, user_scope_shelves: DataFrame) -> DataFrame:
    """(user_id, shelf_id, kind): assigned shelves that are shared or owned by someone else."""
    own = shelves.select(F.col("id").alias("shelf_id"), "kind", "query_match", "owner_id", "visibility")
    granted = user_scope_shelves.join(scoped_readers(users), "user_id", "left_semi").join(own, "shelf_id")
    usable = (F.col("visibility") == "shared") | (F.col("owner_id") != F.col("user_id"))
    answers = (F.col("kind") == "manual") | (F.coalesce("query_match", F.lit("")) != "")
    return granted.where(usable & answers).select("user_id", "shelf_id", "kind")


def shelf_contents(shelf_books: DataFrame, query_matches: DataFrame) -> DataFrame:
    """(shelf_id, book_id) of manual members and saved-search matches together."""
    return shelf_books.select("shelf_id", "book_id").unionByName(query_matches.select("shelf_id", "book_id"))


def visible_books_all(users: DataFrame, shelves: DataFrame, user_scope_shelves: DataFrame,
                      shelf_books: DataFrame, query_matches: DataFrame) -> DataFrame:
    """(user_id, book_id) for every scoped reader; readers without usable shelves have no rows.

    Readers with the same shelves are one access group, named by its lowest reader. The
    assigned shelves are shuffled once, by book; the books of a group's shelves are told
    apart where they lie, so no row of a group and book is shuffled while the groups are
    small enough to be broadcast.
    """
    members = cut_lineage(access_groups(scope_shelves(users, shelves, user_scope_shelves)))
    groups = members.groupBy("shelves").agg(F.min("user_id").alias("group_id"))
    opened = groups.select("group_id", F.explode("shelves").alias("shelf_id"))
    contents = shelf_contents(shelf_books, query_matches).join(if_small(opened.select("shelf_id").distinct()), "shelf_id", "left_semi")
    # A fixed number of partitions: few rows here become many below.
    dealt = contents.repartition(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id")
    seen = dealt.join(if_small(opened), "shelf_id").select("group_id", "book_id").distinct()
    readers = members.join(groups, "shelves").select("user_id", "group_id")
    return seen.join(if_small(readers, 1_000_000), "group_id").select("user_id", "book_id")


def access_groups(granted: DataFrame) -> DataFrame:
    """(user_id, shelves): each reader's usable shelves as a sorted array, which is the same for all readers of a group."""
    return granted.groupBy("user_id").agg(F.array_sort(F.collect_set("shelf_id")).alias("shelves"))


def visible_books(user_id: int, users: DataFrame, shelves: DataFrame, user_scope_shelves: DataFrame,
                  shelf_books: DataFrame, query_matches: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id`` set of one account: the scoped set, or all books for a full account."""
    one = users.where(F.col("id") == user_id)
    scoped = visible_books_all(one, shelves, user_scope_shelves, shelf_books, query_matches).select("book_id")
    limited = scoped_readers(one).agg(F.count(F.lit(1)) > 0).scalar()
    known = one.agg(F.count(F.lit(1)) > 0).scalar()
    everything = books.select(F.col("id").alias("book_id")).where(known & ~limited)
    return everything.unionByName(scoped)


def can_access(requests: DataFrame, users: DataFrame, granted: DataFrame, shelf_books: DataFrame,
               matches: Callable[[DataFrame, DataFrame], DataFrame], books: DataFrame, assets: DataFrame) -> DataFrame:
    """Decide requests (user_id, kind, target_id); kind is live, trashed or asset.

    ``granted`` is (user_id, shelf_id, kind). ``matches`` gives (shelf_id, book_id) for
    some query shelves (shelf_id) and some books (book_id). The work starts from the
    requests: only shelves of the limited readers among them are looked at, and these
    for the requested books alone; what a reader may see is never listed. Requests meet
    their files, books and accounts once, and only those of limited readers go on from there.
    """
    owner = assets.select(F.col("id").alias("target_id"), F.col("book_id").alias("asset_book"))
    files = requests.where("kind = 'asset'").join(owner, "target_id", "left")
    direct = requests.where("kind <> 'asset'").withColumn("asset_book", F.col("target_id"))
    state = books.select(F.col("id").alias("book_id"), F.col("deleted_at").isNotNull().alias("gone"))
    limits = users.select(F.col("id").alias("user_id"), F.lit(True).alias("known")).join(
        scoped_readers(users).withColumn("limited", F.lit(True)), "user_id", "left")
    asked = files.unionByName(direct).withColumnRenamed("asset_book", "book_id").join(limits, "user_id", "left").join(state, "book_id", "left")
    asked = written(asked.select("user_id", "kind", "target_id", "book_id", "limited",
                                 F.coalesce((F.col("gone") == (F.col("kind") == "trashed")) & F.col("known"), F.lit(False)).alias("fits")))
    wanted = cut_lineage(asked.where("limited AND book_id IS NOT NULL").select("user_id", "book_id").distinct())
    places = granted.join(wanted, "user_id", "left_semi")
    found = matches(places.where("kind <> 'manual'").select("shelf_id").distinct(), wanted.select("book_id").distinct())
    # A group is a set of shelves; requests of its readers for one book are one lookup.
    members = access_groups(places)
    pairs = wanted.join(members, "user_id")
    lookups = pairs.select("shelves", "book_id").distinct().select("shelves", "book_id", F.explode("shelves").alias("shelf_id"))
    open_to = lookups.join(shelf_contents(shelf_books, found), ["shelf_id", "book_id"], "left_semi").select("shelves", "book_id").distinct()
    seen = pairs.join(open_to, ["shelves", "book_id"], "left_semi").select("user_id", "book_id").withColumn("seen", F.lit(True))
    free = asked.where("limited IS NULL").select("user_id", "kind", "target_id", F.col("fits").alias("allowed"))
    return free.unionByName(asked.where("limited").join(seen, ["user_id", "book_id"], "left").select(
        "user_id", "kind", "target_id", (F.col("fits") & F.col("seen").isNotNull()).alias("allowed")))
