"""Reading, shared storage and small helpers for the operators of this subpackage."""

from __future__ import annotations

import math
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import ship
from tarmac.sources.stages import remove, scratch  # noqa: F401
from tarmac.sources.stages import stage_path as shared_dir
from tarmac.sources.stages import staged as written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mounted(path: str) -> str:
    """The local path of a shared folder, for files that workers map into memory."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
    return url.path


def publish(path: str, *arrays) -> None:
    """Writes arrays one behind the other, in one step, so that a repeated or rival task leaves a whole file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for a in arrays:
            a.tofile(f)
    os.replace(own, path)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of all texts: what numbers of shards follow from."""
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def shards(n_bytes: int, each: int) -> int:
    return max(1, math.ceil(n_bytes / each))


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % m


#: What a Python worker keeps between tasks: one thing at a time, so that no job lives with another's.
_KEPT: dict = {}


def kept(key: tuple, make):
    """make() of an earlier task of this worker under the same key, or a new one, for which all else goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Frees what earlier tasks of this worker kept."""
    _KEPT.clear()
