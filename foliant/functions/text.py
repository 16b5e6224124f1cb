"""Small text helpers used by every other function module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as text trimming and word splitting understand it.
SPACE = r"[\s\u0085\p{Z}]"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", "")


def words(value: Column) -> Column:
    """Whitespace-separated fields without empty ones."""
    return F.filter(F.split(value, rf"{SPACE}+"), lambda w: w != "")


def squeeze(value: Column) -> Column:
    return F.regexp_replace(strip(value), rf"{SPACE}+", " ")


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def lookup(table: dict[str, str], key: Column) -> Column:
    """A literal dictionary as an expression; null for unknown keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
