"""What the operators share: written tables, column guards and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    A session on a cluster has to name it. A ``local`` master, as in tests, gets
    a folder of its own, since its driver and executor are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="foliant-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The readers get pushdown, column pruning and statistics, and a lost executor
    costs no more than the tasks it was running.
    """
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that nothing reads any more, so that a long session keeps only what it still needs."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores added until none of ``columns`` has the name, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def empty_if_null(column) -> F.Column:
    return F.coalesce(column, F.lit(""))


def text_key(text) -> list[F.Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id that each node of ``edges`` reaches.

    Alternating large-star and small-star rounds: both are a minimum for each node
    (reduced before its shuffle) and an equi-join that AQE may split where a node
    has many edges. A round never makes more edges than it got, and the number of
    rounds grows with the logarithm of the longest path. Nodes without an edge are
    not in the result; loops and repeated edges do no harm.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession)
    edges = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), path)
    seen = _signature(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > u").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, large["b"] == least["u"]).select(F.col("m").alias("x"), F.col("a").alias("y"))
        before, path = path, new_path(spark)
        edges = written(small.union(least.select("m", "u")).where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), path)
        discard(spark, before)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    root = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return root.union(root.select(F.col("component").alias("node"), "component").distinct())
