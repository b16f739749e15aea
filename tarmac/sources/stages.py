"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, which spark.checkpoint.dir names.

    A session on one machine that lacks the setting (a test) gets a temporary folder, which is then set. On a
    cluster every machine would have its own, so there it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more; what isn't there is passed over."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes when the block ends; results must have been written by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        remove(spark, *made)
