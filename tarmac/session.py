"""Session set-up that any job needs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the driver's source tree.

    On a cluster the package is installed on each machine or sent with --py-files; this covers a
    session that was started before the source folder was on the path.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark
