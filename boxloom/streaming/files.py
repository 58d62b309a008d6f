"""Image files as a stream: each micro-batch of new files goes through the same parser and plans, and is appended to tables.

The parser is stateless, so a batch that is done again after a failure gives the same rows; with the batch number as a partition of the
tables, writing it again replaces it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxloom.plans.items import info
from boxloom.sources.container import Limits
from boxloom.sources.tables import Container


def file_stream(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """(file_id, content) of the files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path).select(F.col("path").alias("file_id"), "content")


def write_tables(stream: DataFrame, out: str, checkpoint: str, tables: dict[str, Callable[[Container], DataFrame]] | None = None, limits: Limits | None = None, once: bool = True) -> StreamingQuery:
    """Writes tables made of each batch's container under `out`, a folder for each, partitioned by batch."""
    made = tables or {"info": info, "items": lambda c: c.items, "props": lambda c: c.props.drop("icef")}

    def batch(files: DataFrame, number: int) -> None:
        c = Container(files, limits, keep=True)
        for name, make in made.items():
            make(c).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        c.release()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
