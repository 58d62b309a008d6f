"""Measures on pictures and on sets of files: differences, thumbnails of means, hashes, verdicts, picks and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions.colour import div
from boxloom.sources.boxes import Fields


def difference(left: DataFrame, right: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, n, sse, mse, max_diff, n_diff) of pixel rows that agree in keys, x, y and ch."""
    both = left.select(*keys, "x", "y", "ch", F.col(value).alias("l")).join(right.select(*keys, "x", "y", "ch", F.col(value).alias("r")), [*keys, "x", "y", "ch"])
    d = (F.col("l") - F.col("r")).cast("bigint")
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d * d).alias("sse"), F.max(F.abs(d)).alias("max_diff"), F.count_if(d != 0).alias("n_diff"))
    return out.withColumn("mse", F.col("sse") / F.col("n"))


def picture_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, sse, max_diff, n_diff, mse) of decoded pictures that agree in keys; null where their sizes or formats don't agree.

    Pictures meet whole, one row each, and are compared in one pass over their bytes."""
    shape = ["width", "height", "format", "data"]
    one = lambda df, name: df.where("error is null").select(*keys, F.struct(*shape).alias(name))
    both = one(left, "l").join(one(right, "r"), keys)
    schema = T.StructType([*[left.schema[k] for k in keys], *T.StructType.fromDDL("n long, sse long, max_diff long, n_diff long, mse double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, r = (b.column(b.schema.get_field_index(k)) for k in ("l", "r"))
            same = [all(l.field(k)[i].as_py() == r.field(k)[i].as_py() for k in shape[:3]) for i in range(b.num_rows)]
            out = []
            for i, ok in enumerate(same):
                x, y = (np.frombuffer(c.field("data")[i].as_buffer(), np.uint8).astype(np.int64) for c in (l, r))
                d = np.abs(x - y) if ok else None
                out.append((len(d), int((d * d).sum()), int(d.max(initial=0)), int(np.count_nonzero(d)), float((d * d).sum()) / max(len(d), 1)) if ok else (None,) * 5)
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True))], names=schema.names)

    return both.select(*keys, "l", "r").mapInArrow(run, schema)


def paired(images: DataFrame, of: Column, what: list[str], pair: str = "pair") -> DataFrame:
    """(pair, l, r): pictures that meet, decoded once each and dealt to all their pairs in one shuffle. `of` is an array of (pair, side) made
    of a picture's row, side being 0 or 1; pairs that lack one are left out."""
    dealt = images.where("error is null").select(F.explode(of).alias("of"), F.struct(*what).alias("picture"))
    side = lambda n: F.first(F.when(F.col("of.side") == n, F.col("picture")), ignorenulls=True)
    return dealt.groupBy(F.col("of.pair").alias(pair)).agg(side(0).alias("l"), side(1).alias("r")).where("l is not null and r is not null")


def differences(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """(key, n, sse, max_diff, n_diff, mse) of pairs of pictures (l, r) with width, height, format and data."""
    schema = T.StructType([pairs.schema[key], *T.StructType.fromDDL("n long, sse long, max_diff long, n_diff long, mse double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [compared(*(b.column(c).field("data")[i].as_buffer() for c in (1, 2)), all(b.column(1).field(k)[i] == b.column(2).field(k)[i] for k in ("width", "height", "format"))) for i in range(b.num_rows)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True))], names=schema.names)

    return pairs.select(key, "l", "r").mapInArrow(run, schema)


def compared(left: pa.Buffer, right: pa.Buffer, same: bool, kind: str = "u1") -> tuple:
    """(n, sse, max_diff, n_diff, mse) of two runs of samples; nulls where they aren't alike in shape."""
    if not same:
        return (None,) * 5
    x, y = (np.frombuffer(c, kind).astype(np.int64) for c in (left, right))
    d = np.abs(x - y)
    sse = int((d * d).sum())
    return len(d), sse, int(d.max(initial=0)), int(np.count_nonzero(d)), sse / max(len(d), 1)


def plane_differences(left: DataFrame, right: DataFrame, keys: list[str], digests: bool = False) -> DataFrame:
    """(keys, plane, depth, n, sse, max_diff, md5_equal) of each plane of pictures (keys, planes); a plane that one side lacks, or that has
    another size or depth there, has nulls. Each side is decoded once, and its planes meet in one shuffle. With `digests` `md5` follows, that
    of the left side's plane, which is at hand here: joining it from elsewhere would decode that side again, and might send a row for each
    plane to the driver for a broadcast, as the planner can't tell how many rows come out of files."""
    one = lambda df, side: df.select(*keys, F.explode("planes").alias("p")).select(*keys, F.col("p.name").alias("plane"), F.lit(side).alias("side"), F.struct("p.width", "p.height", "p.depth").alias("shape"), F.col("p.data").alias("data"))
    of = lambda c, side: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    met = one(left, "l").unionByName(one(right, "r")).groupBy(*keys, "plane").agg(*[of(c, side).alias(f"{side}_{c}") for side in "lr" for c in ("shape", "data")])
    same = F.coalesce(F.col("l_shape") == F.col("r_shape"), F.lit(False))
    equal = same & (F.md5("l_data") == F.md5("r_data"))
    more = ["md5"] if digests else []
    rows = met.withColumn("md5", F.md5("l_data")).select(*keys, "plane", F.coalesce("l_shape.depth", "r_shape.depth").alias("depth"), F.when(same, F.col("l_shape.width").cast("bigint") * F.col("l_shape.height")).alias("n"), same.alias("same"), F.coalesce(equal, F.lit(False)).alias("md5_equal"), *more, "l_data", "r_data")
    at = len(keys) + 1
    schema = T.StructType([*[rows.schema[k] for k in (*keys, "plane", "depth", "n")], *T.StructType.fromDDL("sse long, max_diff long").fields, *[rows.schema[k] for k in ("md5_equal", *more)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, same, l, r = (b.column(b.schema.get_field_index(c)) for c in ("depth", "same", "l_data", "r_data"))  # noqa: E741
            out = [compared(l[i].as_buffer(), r[i].as_buffer(), True, "<u2" if depth[i].as_py() > 8 else "u1")[1:3] if same[i].as_py() else (None, None) for i in range(b.num_rows)]
            cols = list(zip(*out, strict=True)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[: at + 2], *(pa.array(c, pa.int64()) for c in cols), *(b.column(b.schema.get_field_index(k)) for k in ("md5_equal", *more))], names=schema.names)

    return rows.mapInArrow(run, schema)


def thumbs(images: DataFrame, cells: int = 16) -> DataFrame:
    """The pictures with `means` in place of data: rounded means over cells x cells boxes, a byte for each box and channel, worked out on the
    picture's bytes in one pass. Box t of n samples is [t * n / cells, (t + 1) * n / cells); an empty box has none, so pictures with a side of
    fewer samples have a null."""
    schema = T.StructType([*[f for f in images.schema.fields if f.name != "data"], T.StructField("means", T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]

    def mean(data: pa.Buffer, w: int, h: int, n: int) -> bytes | None:
        if min(w, h) < cells:
            return None
        px = np.frombuffer(data, np.uint8).reshape(h, w, n)
        at = lambda size: np.arange(cells + 1) * size // cells
        rows = np.add.reduceat(px, at(h)[:-1], axis=0, dtype=np.int64)
        sums = np.add.reduceat(rows, at(w)[:-1], axis=1)
        count = np.outer(np.diff(at(h)), np.diff(at(w)))[:, :, None]
        return ((sums + count // 2) // count).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("data", "width", "height", "format")}
            out = [mean(d.as_buffer(), w.as_py(), h.as_py(), len(f.as_py())) if d.is_valid else None for d, w, h, f in zip(col["data"], col["width"], col["height"], col["format"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(out, pa.binary())], names=schema.names)

    return images.mapInArrow(run, schema)


def thumb_verdict(ours: DataFrame, expected: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """(keys, ok, mse, max_diff, detail): pictures against expected sizes and means (keys, width, height, means)."""
    both = ours.select(*keys, F.struct("width", "height", "means", "error").alias("o")).join(expected.select(*keys, F.struct("width", "height", "means").alias("e")), keys)
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i + 1, 1)), 16, 10).cast("int")
    d = F.transform(F.sequence(F.lit(0), F.length("o.means") - 1), lambda i: F.abs(byte(F.col("o.means"), i) - byte(F.col("e.means"), i)))
    alike = F.length("o.means") == F.length("e.means")
    rows = both.withColumn("d", F.when(alike & (F.length("o.means") > 0), d))
    mse = F.aggregate("d", F.lit(0).cast("bigint"), lambda a, x: a + x * x) / F.size("d")
    size = (F.col("o.width") == F.col("e.width")) & (F.col("o.height") == F.col("e.height"))
    detail = F.when(F.col("o.error").isNotNull(), F.col("o.error")).when(~size, F.format_string("size %dx%d != %dx%d", "o.width", "o.height", "e.width", "e.height")).when(F.col("d").isNull(), "means of another length")
    return rows.select(*keys, (detail.isNull() & (mse <= gate)).alias("ok"), F.when(detail.isNull(), mse).alias("mse"), F.when(detail.isNull(), F.array_max("d")).alias("max_diff"), detail.alias("detail"))


def pick(files: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n of the files at random: those of least hash for a seed, so that a run can be done again."""
    return files.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def box_means(pixels: DataFrame, keys: list[str], cells: int = 16) -> DataFrame:
    """(keys, cx, cy, ch, v): rounded means over cells x cells boxes, box t of n samples being [t * n / cells, (t + 1) * n / cells)."""
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    boxes = lambda p, n: F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda t: (div(t * n, cells) <= p) & (p < div((t + 1) * n, cells)))
    placed = pixels.join(size, keys).withColumn("cx", F.explode(boxes(F.col("x"), F.col("w")))).withColumn("cy", F.explode(boxes(F.col("y"), F.col("h"))))
    sums = placed.groupBy(*keys, "cx", "cy", "ch").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return sums.select(*keys, "cx", "cy", "ch", div(F.col("s") + div(F.col("n"), 2), F.col("n")).cast("int").alias("v"))


def verdict(ours: Column, theirs: Column, same_size: Column, mse: Column, gate: float = 8.0) -> Column:
    """How a file compares: ours and theirs tell whether each decoded it."""
    return F.when(~ours & ~theirs, "both_fail").when(~ours, "ours_fail").when(~theirs, "theirs_fail").when(~same_size, "size_mismatch").when(mse <= gate, "match").otherwise("other")


#: Start and factor of the 64-bit hash.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def plane_hash(rows: DataFrame, key: str, samples: str, out: str = "hash") -> DataFrame:
    """(key, hash): samples (array of integers) taken in one by one, as unsigned 64-bit decimal."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).value_lengths().fill_null(0).to_numpy()
            flat, start = b.column(1).flatten().to_numpy().astype(np.uint64), np.cumsum(n) - n
            order = np.argsort(-n, kind="stable")
            h, start, long = np.full(len(n), FNV_START, np.uint64), start[order], -n[order]
            for k in range(-int(long.min(initial=0))):  # the k-th sample of all rows that have one
                some = int(np.searchsorted(long, -k))
                h[:some] = (h[:some] ^ flat[start[:some] + k]) * np.uint64(FNV_FACTOR)
            got = np.empty_like(h)
            got[order] = h
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.tolist(), pa.decimal128(20, 0))], names=[key, out])

    return rows.select(key, samples).mapInArrow(run, f"`{key}` {kind}, {out} decimal(20,0)")


def first_of_each_name(files: DataFrame, root: str, path: str) -> DataFrame:
    """One file for each base name, whatever its case: that of the first root, and there of the first path."""
    name = F.lower(F.element_at(F.split(path, "[/\\\\]"), -1))
    w = Window.partitionBy("_name").orderBy(root, path)
    return files.withColumn("_name", name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_name")


def slowest(times: DataFrame, ours: str, theirs: str, n: int = 10, ignore: float = 2.0) -> DataFrame:
    """The n rows that are relatively slowest against the other side; differences under `ignore` don't count."""
    rel = (F.col(ours) - F.col(theirs)) / F.col(theirs) * 100
    return times.where((F.abs(F.col(ours) - F.col(theirs)) >= ignore) & (F.col(theirs) > 0)).withColumn("percent", rel).orderBy(F.desc("percent"), *[c for c in times.columns if c not in (ours, theirs)]).limit(n)


def best_time(runs: DataFrame, key: str, ms: str) -> DataFrame:
    return runs.groupBy(key).agg(F.min(ms).alias("best_ms"))


def netpbm(images: DataFrame) -> DataFrame:
    """(file_id, ppm): P6 files of rgb pictures."""
    head = F.concat(F.lit("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary")
    return images.where("format = 'rgb' and error is null").select("file_id", F.concat(head, F.col("data")).alias("ppm"))


def annexb_units(rows: DataFrame, key: str = "name", stream: str = "bitstream") -> DataFrame:
    """(key, no, nal_type, first_slice, unit): the units of HEVC byte streams, split at start codes."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, u[0] >> 1 & 63, (u[0] >> 1 & 63) < 32 and len(u) > 2 and u[2] >> 7 == 1, u) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, u in enumerate(split_annexb(s or b""))]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.binary())], names=[key, "no", "nal_type", "first_slice", "unit"])

    return rows.select(key, stream).mapInArrow(run, f"`{key}` {kind}, no int, nal_type int, first_slice boolean, unit binary")


def split_annexb(stream: bytes) -> list[bytes]:
    """What stands between start codes 00 00 01, without the zeros behind."""
    at, out = stream.find(b"\0\0\1"), []
    while at >= 0:
        end = stream.find(b"\0\0\1", at + 3)
        unit = stream[at + 3 : end if end >= 0 else len(stream)].rstrip(b"\0")
        if unit:
            out.append(unit)
        at = end
    return out


def length_prefixed(payload: bytes, size: int) -> list[bytes]:
    """The units of an item's payload, each behind its length in `size` bytes; a unit that leaves the data ends them."""
    f, out = Fields(payload), []
    while f.left >= size and (n := f.u(size)) <= f.left:
        out.append(f.take(n))
    return out


def without_escapes(unit: bytes) -> bytes:
    """A unit's raw bytes: the 03 behind two zeros goes."""
    out, at = bytearray(), 0
    while (hit := unit.find(b"\0\0\3", at)) >= 0:
        out += unit[at : hit + 2]
        at = hit + 3
    return bytes(out + unit[at:])
