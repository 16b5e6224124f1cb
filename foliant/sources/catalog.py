"""The logical tables and their typed load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, S, D, B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _table(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


# Content hashes are hex text (32 characters = 16 bytes), activity times are
# Unix milliseconds, every other *_at is Unix seconds, partial dates stay text.
SCHEMAS: dict[str, T.StructType] = {
    "books": _table(
        ("id", L), ("title", S), ("sort_title", S), ("primary_author_sort", S), ("series", S),
        ("series_index", D), ("description", S), ("publisher", S), ("published_date", S),
        ("language", S), ("identifiers", S), ("manual_overrides", S), ("metadata_rev", L),
        ("cover_version", L), ("created_at", L), ("updated_at", L), ("added_at", L),
        ("deleted_at", L), ("deleted_by", L),
    ),
    "assets": _table(
        ("id", L), ("book_id", L), ("page_count", L), ("storage_path", S), ("filename", S),
        ("original_filename", S), ("extension", S), ("format", S), ("is_primary", B),
        ("original_hash", S), ("current_hash", S), ("original_size", L), ("current_size", L),
        ("sampled_hash", S), ("writeback_rev", L), ("writeback_error", S), ("created_at", L),
        ("updated_at", L),
    ),
    "authors": _table(("id", L), ("name", S), ("sort_name", S)),
    "book_authors": _table(("book_id", L), ("author_id", L), ("role", S), ("author_order", L)),
    "tags": _table(("id", L), ("name", S), ("name_key", S), ("kind", S), ("parent_id", L)),
    "book_tags": _table(("book_id", L), ("tag_id", L), ("position", L)),
    "users": _table(("id", L), ("username", S), ("role", S), ("content_scope", S)),
    "shelves": _table(
        ("id", L), ("name", S), ("kind", S), ("query", S), ("query_match", S), ("owner_id", L),
        ("visibility", S), ("position", L),
    ),
    "shelf_books": _table(("shelf_id", L), ("book_id", L), ("position", L), ("added_at", L)),
    "user_scope_shelves": _table(("user_id", L), ("shelf_id", L)),
    "reading_positions": _table(
        ("user_id", L), ("asset_id", L), ("progress", D), ("locator", S), ("revision", L),
        ("device_id", S), ("updated_at", L),
    ),
    "reading_state": _table(
        ("user_id", L), ("book_id", L), ("status", S), ("last_event_id", L), ("updated_at", L)
    ),
    "reading_events": _table(
        ("id", L), ("user_id", L), ("book_id", L), ("previous_event_id", L), ("from_status", S),
        ("to_status", S), ("source", S), ("occurred_at", L), ("reverted_at", L),
    ),
    "annotations": _table(
        ("id", L), ("user_id", L), ("asset_id", L), ("locator", S), ("revision", L),
        ("deleted", B), ("quote", S), ("context_before", S), ("context_after", S), ("note", S),
        ("color", S), ("created_at", L), ("updated_at", L),
    ),
    "feed_items": _table(
        ("connection_id", L), ("asset_id", L), ("book_id", L), ("fingerprint", S),
        ("present", B), ("revision", L), ("first_revision", L), ("updated_at", L),
    ),
    "duplicate_dismissals": _table(
        ("reason", S), ("detector_key", S), ("book_ids", T.ArrayType(L))
    ),
    "delivery_devices": _table(
        ("id", L), ("user_id", L), ("name", S), ("preset", S), ("is_default", B), ("created_at", L)
    ),
    "delivery_jobs": _table(
        ("id", L), ("user_id", L), ("device_id", L), ("asset_id", L), ("title", S), ("target", S),
        ("size_bytes", L), ("status", S), ("error", S), ("created_at", L), ("updated_at", L),
        ("sent_at", L),
    ),
}


class Catalog:
    """Named logical tables, resolved lazily and remembered.

    ``resolve`` maps a table name to a DataFrame; operators only ever see
    DataFrames, so a catalogue can come from parquet, from views bound onto
    other tables, or from literal rows in a test.
    """

    def __init__(self, spark: SparkSession, resolve: Callable[[str], DataFrame]):
        self.spark = spark
        self._resolve = resolve
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._resolve(name)
        return self._tables[name]

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> "Catalog":
        return cls(spark, tables.__getitem__)


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Typed parquet load: one folder (or file) per logical table under ``path``."""

    def resolve(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")

    return Catalog(spark, resolve)
