"""Where this package puts files that several executors read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, one of this machine's if all runs on it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="boxloom-")
    return f"{where.rstrip('/')}/boxloom-{name}-{uuid.uuid4().hex}"
