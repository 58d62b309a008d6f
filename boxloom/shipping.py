"""Sends this package to the executors, which may not have it."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch; Spark's default of 64 MB, held on both sides of a worker, is much for rows of long texts.
BATCH, DEFAULT = str(4 << 20), "67108864b"


def ship(spark: SparkSession) -> None:
    """Once for each context; a package that is not plain files is taken to be installed everywhere. Sessions that leave the size of
    Arrow batches at its default get smaller ones."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT) == DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    context, here = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_boxloom_shipped", False) or not here.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="boxloom-")) / "boxloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    context.addPyFile(str(target))
    context._boxloom_shipped = True


def shipped(f: Callable) -> Callable:
    """The function, which first sends the package through the session that is its first argument."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args: object, **how: object) -> object:
        ship(spark)
        return f(spark, *args, **how)

    return run
