"""Small files that say which parts make up a version of a stored table, on any file system Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder without the hidden ones, sorted; none if there is no such folder."""
    place, files = _place(spark, folder)
    if not files.exists(place):
        return []
    found = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(name for name in found if not name.startswith((".", "_")))


def put(spark: SparkSession, folder: str, name: str, text: str, replace: bool = False) -> bool:
    """Write ``text`` beside its place and rename it there, so it is whole or absent; false if the name is taken."""
    target, files = _place(spark, f"{folder}/{name}")
    draft, _ = _place(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        files.delete(target, False)
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        return False
    return True


def get(spark: SparkSession, folder: str, name: str) -> str:
    return spark.read.text(f"{folder}/{name}", wholetext=True).first().value


def drop(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)
