"""Session defaults and lineage cutting shared by every operator."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. Partition counts are left to AQE: the initial
# shuffle width only has to be wide enough for the cluster, because AQE
# coalesces small partitions and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "foliant", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    It is named in ``spark.checkpoint.dir``. Without a name only a local master,
    whose driver and executor are one process, gets a folder of its own; on a
    cluster a folder of one machine would be lost to the other executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and sc.master.split("[")[0] == "local":
        named = tempfile.mkdtemp(prefix="foliant-")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed columnar table in the shared checkpoint folder, for large tables that several steps read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def fine_shuffles(spark: SparkSession, megabytes: int = 8) -> Iterator[None]:
    """While an action runs in it, shuffled partitions and splits of files hold few MB, so that their number follows the data.

    For steps that make many rows of each one they read: by the size of what is read, AQE
    would join partitions until what is made of them no longer fits a task's memory.
    """
    first = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{megabytes}m", "spark.sql.files.maxPartitionBytes": f"{megabytes}m",
              "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(first)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, a scan, dealt by ``key`` over the cores if it has fewer splits than there are cores.

    For steps that cost far more than their rows weigh. A table with enough splits is
    left as it is, so a large one is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` narrow rows, else as it is, for a shuffled join.

    A checkpointed table has no size that the planner knows, so its rows are counted, up to the bound.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def version_of(tables: list[DataFrame]) -> str:
    """A name for the state of file tables: of their files with sizes and times of change.

    Each folder is listed once; no file is asked for by itself.
    """
    spark = tables[0].sparkSession
    folders: dict[str, set[str]] = {}
    for name in {name for table in tables for name in table.inputFiles()}:
        folder, file = name.rsplit("/", 1)
        folders.setdefault(folder, set()).add(file)
    known = []
    for folder, files in folders.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        for status in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
            if status.getPath().toUri().getRawPath().rsplit("/", 1)[1] in files:
                known.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(known)).encode()).hexdigest()
