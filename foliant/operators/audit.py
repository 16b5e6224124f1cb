"""The model's CHECK, UNIQUE and FOREIGN KEY clauses as data-quality counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The clauses of the data model. What breaks a CHECK clause is stated as a condition.
HEX = "^[0-9a-f]{32}$"
CHECKS = {
    ("assets", "page_count > 0"): "page_count <= 0",
    ("assets", "hash is 32 hex digits"): f"NOT original_hash RLIKE '{HEX}' OR NOT current_hash RLIKE '{HEX}'",
    ("tags", "kind is known"): "kind NOT IN ('tag', 'genre')",
    ("users", "role is known"): "role NOT IN ('admin', 'member', 'reader')",
    ("users", "scope is known"): "content_scope NOT IN ('all', 'shelves')",
    ("shelves", "kind is known"): "kind NOT IN ('manual', 'query')",
    ("shelves", "visibility is known"): "visibility NOT IN ('personal', 'shared')",
    ("shelves", "query only on query shelves"): "NOT ((kind = 'manual' AND query IS NULL AND query_match IS NULL) OR (kind = 'query' AND query IS NOT NULL AND query_match IS NOT NULL))",
    ("reading_positions", "progress within 0..1"): "progress < 0 OR progress > 1",
    ("reading_positions", "revision not negative"): "revision < 0",
    ("reading_state", "status is known"): "status NOT IN ('unread', 'reading', 'finished', 'dropped')",
    ("reading_events", "old status is known"): "from_status NOT IN ('unread', 'reading', 'finished', 'dropped')",
    ("reading_events", "new status is known"): "to_status NOT IN ('unread', 'reading', 'finished', 'dropped')",
    ("reading_events", "source is known"): "source NOT IN ('manual', 'web_reader', 'kosync', 'opds', 'kobo')",
    ("reading_events", "status changes"): "from_status = to_status",
    ("annotations", "revision is positive"): "revision <= 0",
    ("annotations", "color is known"): "color NOT IN ('yellow', 'green', 'blue', 'pink', 'purple')",
    ("feed_items", "fingerprint is 32 hex digits"): f"NOT fingerprint RLIKE '{HEX}'",
    ("feed_items", "revision is positive"): "revision <= 0",
    ("feed_items", "first revision is positive"): "first_revision <= 0",
    ("delivery_devices", "preset is known"): "preset NOT IN ('kindle', 'pocketbook', 'generic')",
    ("delivery_jobs", "status is known"): "status NOT IN ('queued', 'converting', 'sending', 'sent', 'failed')",
}
UNIQUE = [("books", ["id"], None), ("assets", ["original_hash"], None), ("assets", ["storage_path"], None), ("authors", ["name"], None),
          ("tags", ["kind", "name_key"], None), ("book_authors", ["book_id", "author_id"], None), ("book_tags", ["book_id", "tag_id"], None),
          ("shelf_books", ["shelf_id", "book_id"], None), ("users", ["username"], None), ("assets", ["book_id"], "is_primary"),
          ("user_scope_shelves", ["user_id", "shelf_id"], None), ("reading_positions", ["user_id", "asset_id"], None), ("reading_state", ["user_id", "book_id"], None),
          ("feed_items", ["connection_id", "asset_id"], None), ("feed_items", ["connection_id", "revision"], None), ("delivery_devices", ["user_id"], "is_default")]
FOREIGN = [("assets", "book_id", "books"), ("book_authors", "book_id", "books"), ("book_authors", "author_id", "authors"), ("book_tags", "tag_id", "tags"),
           ("tags", "parent_id", "tags"), ("shelf_books", "shelf_id", "shelves"), ("shelves", "owner_id", "users"), ("user_scope_shelves", "user_id", "users"),
           ("reading_positions", "asset_id", "assets"), ("book_tags", "book_id", "books"), ("shelf_books", "book_id", "books"),
           ("user_scope_shelves", "shelf_id", "shelves"), ("reading_positions", "user_id", "users"), ("reading_state", "user_id", "users"),
           ("reading_state", "book_id", "books"), ("annotations", "user_id", "users"), ("annotations", "asset_id", "assets"), ("books", "deleted_by", "users"),
           ("delivery_devices", "user_id", "users"), ("delivery_jobs", "user_id", "users"), ("feed_items", "asset_id", "assets"), ("feed_items", "book_id", "books")]


def _key(table: DataFrame, columns: list[str]) -> list[Column]:
    """One or two whole numbers as they are, other keys as 128 bits of hash; nulls are equal to each other and to nothing else."""
    if len(columns) <= 2 and all(isinstance(table.schema[c].dataType, T.IntegralType) for c in columns):
        return [F.col(c).cast("long") for c in columns]
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)]


def _entry(rule: int, key: list[Column], only: str | None = None, owner: bool = False) -> Column:
    """What one row adds to a rule: its key in two numbers, the second of them null where one is enough."""
    k1, k2 = (*key, F.lit(None).cast("long"))[:2]
    entry = F.struct(F.lit(rule).alias("rule"), F.lit(owner).alias("owner"), k1.alias("k1"), k2.alias("k2"))
    return F.when(F.expr(only), entry) if only else entry


def audit_constraints(catalog) -> DataFrame:
    """(tbl, rule, violations) of every clause: one scan for each table, one shuffle of keys for all of them.

    A row becomes an entry of each rule it takes part in: its key for a UNIQUE clause,
    one fixed key where it breaks a CHECK clause, the column for a FOREIGN KEY clause,
    whose owners enter their ids as such. Entries of a key are counted before and
    after the shuffle, so a hot key is a row for each task. A UNIQUE clause counts the
    keys held twice; CHECK and FOREIGN KEY clauses count rows, and nulls break neither.
    A clause of an empty table has no violations.
    """
    names, entries = [], {}

    def note(table: str, *args, **kwargs) -> None:
        entries.setdefault(table, []).append(_entry(len(names), *args, **kwargs))

    for table, keys, only in UNIQUE:
        note(table, _key(getattr(catalog, table), keys), only)
        names.append((table, {"is_primary": "one primary per book", "is_default": "one default per user"}.get(only, "unique " + ", ".join(keys))))
    for (table, rule), broken in CHECKS.items():
        note(table, [F.lit(0).cast("long")], broken)
        names.append((table, rule))
    for table, column, target in FOREIGN:
        note(table, [F.col(column).cast("long")], f"{column} IS NOT NULL")
        note(target, [F.col("id").cast("long")], owner=True)
        names.append((table, f"{column} in {target}"))

    scans = [getattr(catalog, table).select(F.inline(F.array(*made))).where("rule IS NOT NULL") for table, made in entries.items()]
    rows = reduce(DataFrame.unionByName, scans)
    keys = rows.groupBy("rule", "k1", "k2").agg(F.count_if(~F.col("owner")).alias("n"), F.max("owner").alias("owned"))
    broken = F.when(F.col("rule") < len(UNIQUE), (F.col("n") > 1).cast("long")).when(~F.col("owned"), F.col("n")).otherwise(0)
    counts = keys.groupBy("rule").agg(F.sum(broken).alias("violations"))
    named = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(table).alias("tbl"), F.lit(rule).alias("rule")) for i, (table, rule) in enumerate(names)])
    # One row for each clause at most.
    return rows.sparkSession.range(1).select(F.inline(named)).join(F.broadcast(counts.withColumnRenamed("rule", "at")), "at", "left").select(
        "tbl", "rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
