"""Files as tables: one pass of the parser over (file_id, content), then a DataFrame for each kind of row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.sources.boxes import box_tree
from boxloom.sources.container import Limits, parse
from boxloom.sources.movies import with_movies
from boxloom.sources.schema import FILE, NESTED, ROWS

def parse_files(files: DataFrame, limits: Limits | None = None, file_id: str = "file_id", content: str = "content", keep: bool = False) -> DataFrame:
    """A row for each file: its id, what FILE names and, nested, the rows of each table; with `keep` its content, too. A damaged file has
    an error and no rows."""
    kind = files.schema[file_id].dataType
    body = T.StructType.fromDDL(f"{FILE}, file_len: bigint, " + ", ".join(f"{k}: array<struct<{v}>>" for k, v in (ROWS | NESTED).items()))
    schema = T.StructType([T.StructField("file_id", kind), *body.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in body.fields if f.name != "file_len"]
    full = schema.add("content", T.BinaryType()) if keep else schema
    columns = [f.name for f in full.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for i, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = x.as_py() or b""
                    got = parse(data, limits)
                    rows.append({"file_id": i, "file_len": len(data)} | {k: got.get(k) for k in names})
                out = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([*out.columns, part.column(1)], names=columns) if keep else out

    return files.select(F.col(file_id).alias("file_id"), F.col(content).alias("content")).mapInArrow(run, full)


def box_rows(files: DataFrame) -> DataFrame:
    """(file_id, box_id, parent_id, depth, type, content_off, content_len) of all boxes of (file_id, content), up to a header that can't
    be right."""
    kind = files.schema["file_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"file_id {kind}, box_id int, parent_id int, depth int, type string, content_off bigint, content_len bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [dict(zip(schema.names, (i, *r), strict=True)) for r in box_tree(x or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("file_id", "content").mapInArrow(run, schema)


@F.udtf(returnType="box_id int, parent_id int, depth int, type string, content_off bigint, content_len bigint")
class BoxScan:
    """box_rows() as a table function of SQL: a row for each box of one file's content."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from box_tree(content or b"")


def register_functions(spark: SparkSession) -> None:
    """Makes box_scan known to SQL: SELECT f.file_id, b.* FROM files f, LATERAL box_scan(f.content) b."""
    spark.udtf.register("box_scan", BoxScan)


class Container:
    """The tables of some files; what is derived from the parsed rows is plain Catalyst. Movies that can be shown have items of their own
    (see movies.py) wherever items are. With `keep` the parsed rows are kept until release(), for several questions about the same files;
    they hold no contents."""

    def __init__(self, files: DataFrame, limits: Limits | None = None, keep: bool = False):
        self.contents = files.select("file_id", "content")
        self.limits = limits or Limits()
        self.raw = parse_files(self.contents, self.limits)
        if keep:
            self.raw = self.raw.persist(StorageLevel.MEMORY_AND_DISK)

    @classmethod
    def of(cls, parsed: DataFrame, limits: Limits | None = None) -> Container:
        """The same on rows that are parsed already, without contents."""
        out = cls.__new__(cls)
        out.limits, out.raw = limits or Limits(), parsed
        return out

    @cached_property
    def parsed(self) -> DataFrame:
        return with_movies(self.raw, self.limits)

    @cached_property
    def whole(self) -> DataFrame:
        """The parsed rows with the contents of their files beside them, so that items are cut where the file is; never kept."""
        return with_movies(parse_files(self.contents, self.limits, keep=True), self.limits)

    def release(self) -> None:
        self.raw.unpersist()

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.drop(*ROWS, *NESTED, "primary_no", "has_meta", "movie")

    def rows(self, table: str) -> DataFrame:
        rows = self.raw if table == "tracks" else self.parsed
        return rows.select("file_id", F.explode(table).alias("r")).select("file_id", "r.*")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ROWS:
            raise AttributeError(name)
        return self.rows(name)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_id, content) of the files of a folder; the path is the id."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_id"), "content")
