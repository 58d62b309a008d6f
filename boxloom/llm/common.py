"""What the operators of this package share: working folders, staged tables, exact prefix sums and hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
#: Odd base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a folder of our own if all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="boxloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/boxloom-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: cuts the lineage and survives lost executors.

    The shuffles of the writing are dropped as soon as the table is there; nothing else reads them."""
    spark, path, setting = df.sparkSession, stage_path(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/boxloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of phases that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), _U)
    out[0], have = 1, 1
    step = base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(step)
        have += more
        step = step * step & ((1 << 64) - 1)
    return out[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_codes(seed: int = 1) -> np.ndarray:
    """A random 64-bit code for each byte."""
    return mix64(np.arange(1, 257, dtype=_U) * _U(BASE) + _U(seed))


class Words:
    """Words of a batch of texts as 64-bit hashes: runs of bytes outside space and 0x09-0x0D, A-Z lowered.

    hashes holds the words of all texts in order, first[i]:first[i + 1] those of text i."""

    SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
    CODES = byte_codes(7)[LOWER]
    _pow = powers(BASE, 1 << 16)
    _inv = powers(BASE_INV, 1 << 16)

    def __init__(self, texts: list[bytes]):
        n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        start = np.concatenate([[0], np.cumsum(n + 1)])
        if len(Words._pow) <= len(data):
            Words._pow, Words._inv = powers(BASE, len(data) + 1), powers(BASE_INV, len(data) + 1)
        space = Words.SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        sums = np.empty(len(data) + 1, _U)
        sums[0] = 0
        np.cumsum(Words.CODES[data] * Words._pow[: len(data)], out=sums[1:])
        self.hashes = mix64((sums[end] - sums[begin]) * Words._inv[begin] + (end - begin).astype(_U))
        self.first = np.searchsorted(begin, start)
        self.begin, self.end, self.start = begin, end, start

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words, and where those of each text begin; a text of 1 to n - 1 words has one, its whole sequence."""
        w, count = self.hashes, np.diff(self.first)
        many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        at = np.concatenate([[0], np.cumsum(many)])
        out = np.zeros(at[-1], _U)
        full = np.repeat(count >= n, many)
        place = np.repeat(self.first[:-1] - at[:-1], many) + np.arange(at[-1])
        for k in range(n):
            out[full] = mix64(out[full] + _U(BASE)) ^ w[place[full] + k]
        for i in np.flatnonzero((count > 0) & (count < n)):
            h = np.zeros(1, _U)
            for x in w[self.first[i] : self.first[i + 1]]:
                h = mix64(h + _U(BASE)) ^ x
            out[at[i]] = mix64(h ^ _U(count[i] + 1))[0]
        return mix64(out), at


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of a text column: what a batch holds does not follow the lengths of its texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """Adds to each row the sum of value over all rows before it in the given order, within its group if one is named.

    Rows are dealt by ranges of (group, order) and summed within each range in one pass; only one total for each range and
    group is gathered, so a group that holds most rows is spread like any other. The rows are staged between the two steps.
    Null values count as 0. Rows that tie in all order columns stay in one range, in any order."""
    keys = ([F.col(group).asc_nulls_last()] if group else []) + [F.col(c).asc_nulls_first() for c in order]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])

    def run(batches):
        part, carry, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            if group:
                g = b.column(group)
                codes = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
                run_of = np.searchsorted(first, np.arange(len(v)), "right") - 1
                before = before - before[first][run_of]
                if last == (g[0].as_py(),):
                    before[run_of == 0] += carry
                last = (g[-1].as_py(),)
            else:
                before += carry
            carry = int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(before)], names=schema.names)

    local = staged(df.repartitionByRange(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "ranges")
    by = ["_part", *([group] if group else [])]
    totals = local.groupBy(*by).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long").alias("_total"))
    w = Window.partitionBy(F.col(group) if group else F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_base"))
    on = F.col("_part") == F.col("_k0")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_k1"))
    return local.join(base, on).withColumn(out, F.col("_before") + F.col("_base")).drop("_part", "_before", "_base", *[f"_k{i}" for i in range(len(by))])
