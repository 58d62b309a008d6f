"""The data source `heif`: image files read by ranges, and files written once.

    from boxloom.sources import heif
    heif.register(spark)
    spark.read.format("heif").load("/images")                                # a row of nested tables for each file
    spark.read.format("heif").option("rows", "items").load("/images")        # a row for each item, with its payload
    heif.container(spark, "/images")                                         # the tables of those rows

Of a file only its box headers and the boxes that hold tables are read, and of items only the extents of those asked for; whole contents
are never in a row, so files of any size can be read. `bytes_read` tells how many bytes it took. Filters on file_id and file_len choose
among the files before any is opened, those on item_type and item_id among items before a payload is read.

    rows.write.format("heif").mode("append").save("/out")                    # rows (name string, content binary)

Each task writes into a folder of its own attempt; files get their names when all tasks have ended, so a task that is done again, or a job
that fails, leaves no file twice and none in part. A name that is there already, or is written by two rows, is an error."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.sources.boxes import outline
from boxloom.sources.container import Limits, parse_boxes
from boxloom.sources.schema import FILE, NESTED, ROWS
from boxloom.sources.tables import Container

#: Boxes that hold tables.
TABLES = {"ftyp", "meta", "mini", "moov"}
FILES = f"file_id string, {FILE.replace(':', '')}, file_len bigint, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in (ROWS | NESTED).items()) + ", bytes_read bigint"
ITEMS = "file_id string, file_len bigint, item_id bigint, item_type string, name string, content_type string, hidden boolean, payload binary, error string, bytes_read bigint"


def system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class Ranges:
    """A file that is read by ranges, and how many bytes that took."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.taken = fs.open_input_file(path), 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        self.taken += len(out)
        return out


def payload(location: dict, row: dict, size: int, read) -> tuple[bytes | None, str | None]:
    """(payload, error) of an item, its extents put together; nothing is read where one leaves the data."""
    parts, method = location["parts"], location["method"]
    base, limit = (0, size) if method == 0 else (row["idat_off"], row["idat_len"])
    if not parts:
        return None, "no extents"
    if method > 1:
        return None, "an unknown construction method"
    if limit is None:
        return None, "no idat"
    if any(p["at"] + p["length"] > limit for p in parts) or sum(p["length"] for p in parts) > limit:
        return None, "an extent leaves the data"
    return b"".join(read(base + p["at"], p["length"]) for p in parts), None


TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    IsNotNull: lambda x, v: True, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Chosen(InputPartition):
    files: list[tuple[str, str, int]]  # path, its name to the outside, size


class HeifReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options, self.pushed = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {"file_id", "file_len"} | ({"item_type", "item_id"} if self.options.get("rows") == "items" else set())
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in known:
                self.pushed.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def holds(self, **values: object) -> bool:
        return all(x is not None and TESTS[kind](x, value) for name, kind, value in self.pushed if name in values for x in (values[name],))

    def partitions(self) -> list[Chosen]:
        """Files of the folder, `files` of them in a partition; those that filters leave out are never opened."""
        fs, path = system(self.options["path"])
        prefix, pattern = self.options["path"].removesuffix(path), self.options.get("pattern", "*")
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        hidden = lambda f: any(x[:1] in "_." for x in f.path[len(path) :].split("/") if x)
        files = sorted((f.path, prefix + f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, pattern) and not hidden(f))
        files = [f for f in files if self.holds(file_id=f[1], file_len=f[2])]
        n = int(self.options.get("files", "128"))
        return [Chosen(files[i : i + n]) for i in range(0, len(files), n)] or [Chosen([])]

    def read(self, partition: Chosen) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        fs, _ = system(self.options["path"])
        limits = Limits(*(int(self.options.get(k, d)) for k, d in (("width", 16_384), ("height", 16_384), ("pixels", 256_000_000))))
        rows, held = [], 0
        for path, name, size in partition.files:
            source = Ranges(fs, path)
            with source.file:
                row = parse_boxes(outline(source.read, size, TABLES), size, limits) | {"file_id": name, "file_len": size}
                if self.options.get("rows") != "items":
                    rows.append(row | {"bytes_read": source.taken})
                for loc in row["locations"] if self.options.get("rows") == "items" else ():
                    node = next((n for n in row["nodes"] if n["item_id"] == loc["item_id"]), None)
                    if node and self.holds(item_type=node["item_type"], item_id=node["item_id"]):
                        data, error = payload(loc, row, size, source.read)
                        rows.append(node | {"file_id": name, "file_len": size, "payload": data, "error": error, "bytes_read": source.taken})
                        held += len(data or b"")
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it stands, its name


class HeifWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator[T.Row]) -> Written:
        fs, path = system(self.path)
        folder, out = f"{path}/_attempts-{self.job}/{uuid.uuid4().hex}", []
        for i, row in enumerate(rows):
            if i == 0:
                fs.create_dir(folder, recursive=True)
            if not row["name"] or row["name"][:1] in "_./" or ".." in row["name"].split("/"):
                raise ValueError(f"{row['name']!r} is no name for a file")
            with fs.open_output_stream(f"{folder}/{i}") as f:
                f.write(row["content"] or b"")
            out.append((f"{folder}/{i}", row["name"]))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        """Names (not contents) of the files come to the driver, as with any commit of files."""
        fs, path = system(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        taken = [n for n in names if fs.get_file_info(f"{path}/{n}").type != pafs.FileType.NotFound]
        if len(set(names)) < len(names) or taken:
            self._clear()
            raise ValueError(f"two files would have one name: {(taken or sorted(n for n in names if names.count(n) > 1))[:3]}")
        for folder in {f"{path}/{n}".rsplit("/", 1)[0] for n in names}:
            fs.create_dir(folder, recursive=True)
        for at, name in files:
            fs.move(at, f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, path = system(self.path)
        if fs.get_file_info(f"{path}/_attempts-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_attempts-{self.job}")


class HeifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heif"

    def schema(self) -> str:
        return ITEMS if self.options.get("rows") == "items" else FILES

    def reader(self, schema: T.StructType) -> HeifReader:
        return HeifReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> HeifWriter:
        if overwrite:
            raise ValueError("files are only appended; choose another folder")
        if {"name", "content"} - set(schema.names):
            raise ValueError("rows to write are (name string, content binary)")
        return HeifWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach sources written in Python (off by default)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeifSource)


def container(spark: SparkSession, path: str, limits: Limits | None = None, **options: object) -> Container:
    """The tables of the files of a folder, but for what needs contents; payloads are read by the rows `items`."""
    lim = limits or Limits()
    found = spark.read.format("heif").options(width=lim.width, height=lim.height, pixels=lim.pixels, **options).load(path)
    return Container.of(found.drop("bytes_read"), lim)


def payloads(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file_id, file_len, item_id, item_type, name, content_type, hidden, payload, error, bytes_read) of items."""
    return spark.read.format("heif").options(rows="items", **options).load(path)
