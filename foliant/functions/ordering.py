"""Collation, sort keys, bounded top lists and scalable row numbering."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut_lineage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def nocase(value: Column | str) -> Column:
    """ASCII-only case folding: listings ignore case for A-Z and nothing else."""
    return F.translate(F.col(value) if isinstance(value, str) else value, _UPPER, _UPPER.lower())


@dataclass(frozen=True)
class Key:
    """One sort key with an explicit place for nulls."""

    expr: Column
    desc: bool = False
    nulls_last: bool = False

    def sort(self) -> Column:
        if self.desc:
            return self.expr.desc_nulls_last() if self.nulls_last else self.expr.desc_nulls_first()
        return self.expr.asc_nulls_last() if self.nulls_last else self.expr.asc_nulls_first()

    def before(self, other: Column) -> Column:
        """True when this row's value sorts strictly before ``other``."""
        mine = self.expr
        less = mine > other if self.desc else mine < other
        null_first = mine.isNull() & other.isNotNull()
        null_last = mine.isNotNull() & other.isNull()
        return F.coalesce(less, F.lit(False)) | (null_last if self.nulls_last else null_first)


def sorts(keys: list[Key]) -> list[Column]:
    return [key.sort() for key in keys]


def row_before(keys: list[Key], others: list[Column]) -> Column:
    """Lexicographic 'sorts before' over several keys."""
    terms, equal = [], F.lit(True)
    for key, other in zip(keys, others):
        terms.append(equal & key.before(other))
        equal = equal & key.expr.eqNullSafe(other)
    return reduce(lambda a, b: a | b, terms)


def page(df: DataFrame, keys: list[Key], limit: int | None, offset: int = 0, rank: str | None = "rn") -> DataFrame:
    """One page of a sorted listing, with its 1-based place in the whole list.

    The page itself is a TakeOrderedAndProject; the window only numbers the
    at most ``limit`` rows that are left. Without a limit the whole list is
    numbered, over range partitions.
    """
    if limit is None:
        placed = number_rows(df, keys, rank or "_rn")
        placed = placed.where(F.col(rank or "_rn") > offset) if offset else placed
        return placed if rank else placed.drop("_rn")
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.expr.alias(n) for k, n in zip(keys, names)])
    placed = [Key(F.col(n), k.desc, k.nulls_last).sort() for k, n in zip(keys, names)]
    top = keyed.orderBy(*placed)
    top = (top.offset(offset) if offset else top).limit(limit)
    if rank:
        top = top.withColumn(rank, F.row_number().over(Window.orderBy(*placed)).cast("long") + offset)
    return top.drop(*names)


def number_rows(df: DataFrame, keys: list[Key], name: str = "rn") -> DataFrame:
    """Number all rows in sort order, 1-based, without a one-task sort.

    Rows are range-partitioned on the full key (so equal leading values can
    still be split), numbered inside each partition, written to the checkpoint
    folder so that both passes see the same partitions, and shifted by the
    row counts of the earlier partitions - a table as long as the number of
    partitions.
    """
    ranged = df.repartitionByRange(*sorts(keys)).sortWithinPartitions(*sorts(keys))
    place = F.monotonically_increasing_id()
    staged = cut_lineage(ranged.withColumn("_at", place))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    staged = staged.withColumn("_part", part)
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return (
        staged.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + row + 1).cast("long"))
        .drop("_at", "_part", "_start")
    )


def first_per(df: DataFrame, group: list[str], keys: list[Key], columns: list[str]) -> DataFrame:
    """The first row of each group under ``keys``.

    Only ascending, nulls-first or never-null numeric/text keys: the choice is
    a ``min_by`` over a struct, so hot groups are reduced before the shuffle.
    """
    order = F.struct(*[k.expr.alias(f"k{i}") for i, k in enumerate(keys)])
    return (
        df.groupBy(*group)
        .agg(F.min_by(F.struct(*columns), order).alias("_first"))
        .select(*group, *[F.col(f"_first.{c}").alias(c) for c in columns])
    )


def running_sum(df: DataFrame, group: list[str], keys: list[Key], bucket: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each group.

    ``bucket`` splits a group into consecutive slices of its order, so that a
    hot group is summed slice by slice: rows inside a slice in one window, and
    the slices' totals - one row each - in a second one.
    """
    sliced = df.withColumn("_slice", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*group, "_slice").orderBy(*sorts(keys)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total")).select(
        *group, "_slice", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(totals, [*group, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_value", "_inside", "_before")
    )


def previous_row(df: DataFrame, group: list[str], keys: list[Key], bucket: Column, columns: list[str], name: str) -> DataFrame:
    """The preceding row of each group as a struct column, null for the first.

    Like :func:`running_sum`, works slice by slice: the last row of every
    slice is an aggregate, carried to the next non-empty slice.
    """
    sliced = df.withColumn("_slice", bucket).withColumn("_row", F.struct(*columns))
    inside = Window.partitionBy(*group, "_slice").orderBy(*sorts(keys))
    across = Window.partitionBy(*group).orderBy("_slice")
    place = F.struct(*[k.expr.alias(f"k{i}") for i, k in enumerate(keys)])
    lasts = sliced.groupBy(*group, "_slice").agg(F.max_by("_row", place).alias("_last")).select(
        *group, "_slice", F.lag("_last").over(across).alias("_carried"))
    return (
        sliced.withColumn("_before", F.lag("_row").over(inside))
        .join(lasts, [*group, "_slice"])
        .withColumn(name, F.coalesce("_before", "_carried"))
        .drop("_slice", "_row", "_before", "_carried")
    )
