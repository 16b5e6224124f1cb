"""Ordered folds for rules whose outcome depends on what was accepted before."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# step(state, row) -> (state, result tuple); state is None at the start of a group.
Step = Callable[[object, object], tuple[object, tuple]]


def fold_sorted(df: DataFrame, group: list[str], order: list[str], results: str, step: Step) -> DataFrame:
    """Run ``step`` over each group's rows in order and append its results to every row.

    Groups are spread by hash and sorted on the executors; a task walks its
    sorted rows batch by batch and keeps one group's state at a time, so a
    long group streams through and is never held in memory. Values come as
    they are typed: a null is None, an integer stays one, and a null key is a
    group like any other.
    """
    added = _parse_datatype_string(results)
    shape = StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)
    columns = df.columns
    at = [columns.index(g) for g in group]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = namedtuple("line", columns)
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                key = tuple(values[i] for i in at)
                if key != current:
                    current, state = key, None
                state, result = step(state, line(*values))
                out.append(result)
            new = [pa.array([r[i] for r in out], field.type) for i, field in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *arrow.names])

    spread = df.repartition(*group).sortWithinPartitions(*group, *order)
    return spread.mapInArrow(walk, shape)
