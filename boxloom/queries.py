"""The registered queries on files and pictures, and the SQL they are held against.

The tables hold no image files, so each query writes files from table rows (boxloom.sources.writer), reads them back through the
operators it names, and returns what they say; the SQL computes the same from the table rows alone. Queries named expr_ check
expressions on table columns, without files."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import colour
from boxloom.operators import metrics
from boxloom.operators.decode import at_stride, needed_bytes, pictures, pixels, planes
from boxloom.plans import derived, streams
from boxloom.plans import items as it
from boxloom.plans.sequences import Sequences, lookup, rescale
from boxloom.shipping import shipped
from boxloom.sources import heif
from boxloom.sources import writer as w
from boxloom.sources.folders import shared_folder
from boxloom.sources.container import Limits
from boxloom.sources.tables import Container, box_rows, register_functions

ALPHA, GAIN = "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", "urn:com:apple:photo:2020:aux:hdrgainmap"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """(file_id, content): a file for each row; the first column is the id, and make gets the row's values.

    Rows are dealt over all cores first: a table of a few MB is one or two splits, and a row of it is a file to write, parse and decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [make(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["file_id", "content"])

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, rows.columns[0]).mapInArrow(run, "file_id long, content binary")


# ---- containers ----


def _brand_file(key: int) -> bytes:
    k = key % 6
    brands = [["mif1", "avif"], ["mif1", "heic"], ["msf1"], ["mif1"], ["heic", "avis"], ["mif1"] * 15 + ["avif"]][k]
    return w.still([{"id": 1, "type": "hvc1", "props": [1]}], [w.ispe(1, 1)], brands=brands)


def file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Container(written(table(spark, sf_dir, "customer").select("c_custkey"), _brand_file))
    return c.files.select("file_id", it.kind(F.concat(F.array("brand"), "brands"), F.lit(False)).alias("kind"))


FILE_KIND = """SELECT c_custkey AS file_id, CASE c_custkey % 6 WHEN 0 THEN 'avif' WHEN 1 THEN 'heic' WHEN 2 THEN 'sequence' WHEN 4 THEN 'avif' ELSE 'heif' END AS kind FROM customer"""


def _nation_file(key: int, name: str) -> bytes:
    n = key % 4 + 1
    return w.still([{"id": i + 1, "type": "mime", "name": name, "content_type": "text/plain", "props": [1]} for i in range(n)], [w.ispe(4, 4), w.box("free", bytes(key))]) + w.box("free", name.encode()) + b"\0\0\0\5bad!"


def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = box_rows(written(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _nation_file))
    return boxes.groupBy("file_id", "type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "free", F.col("content_len"))).alias("free_bytes"))


BOX_SCAN = """SELECT n_nationkey::BIGINT AS file_id, t.type, CASE t.type WHEN 'infe' THEN n_nationkey % 4 + 1 WHEN 'free' THEN 2 ELSE 1 END::BIGINT AS n,
CASE WHEN t.type = 'free' THEN n_nationkey + length(n_name) END::BIGINT AS free_bytes
FROM nation, (VALUES ('ftyp'), ('meta'), ('hdlr'), ('pitm'), ('iloc'), ('iinf'), ('infe'), ('iprp'), ('ipco'), ('ispe'), ('free'), ('ipma'), ('iref'), ('mdat')) t(type)"""


def _order_file(key: int, lines: list[dict]) -> bytes:
    items = []
    for r in lines:
        body = f"{r['q']}|{r['d']}".encode()
        cut = r["n"] % len(body)
        items.append({"id": r["n"], "type": "mime" if r["f"] == "A" else "Exif", "name": r["s"], "content_type": f"text/{r['f']}" if r["f"] == "A" else None, "hidden": r["n"] % 2 == 0, "parts": [body[:cut], body[cut:]] if cut else [body], "idat": r["n"] % 3 == 0})
    return w.still(items, [w.ispe(1, 1)])


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).alias("r"))
    files = written(line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("lines")), _order_file)
    c = Container(files)
    return it.item_payloads(c).select("file_id", "item_id", "item_type", "name", "content_type", "hidden", F.col("payload").cast("string").alias("payload"))


ORDER_ITEMS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity::INT, strftime(l_shipdate, '%Y-%m-%d'), l_returnflag, l_linestatus) AS k FROM lineitem)
SELECT l_orderkey AS file_id, l_linenumber::BIGINT AS item_id, CASE WHEN l_returnflag = 'A' THEN 'mime' ELSE 'Exif' END AS item_type, l_linestatus AS name,
CASE WHEN l_returnflag = 'A' THEN 'text/A' ELSE '' END AS content_type, l_linenumber % 2 = 0 AS hidden, (l_quantity::INT)::VARCHAR || '|' || strftime(l_shipdate, '%Y-%m-%d') AS payload FROM r WHERE k = 1"""


def _info_file(key: int, size: int) -> bytes:
    codec = [w.hvcc(8 + 2 * (key % 2)), w.av1c(8 + 2 * (key % 3 % 2)), w.hvcc(12), w.hvcc(10)][key % 4]
    kind = ["hvc1", "av01", "grid", "iden"][key % 4]
    props = [w.ispe(size + 8, size + 3), codec, w.irot(size % 3), w.clap(size + 1, size + 2), w.nclx(1, 13, 6, bool(key % 2)), w.auxc(ALPHA), w.auxc(GAIN)]
    derived = key % 4 > 1
    turns = [3] + ([4] if size % 5 == 0 else [])
    color = [5] if key % 6 == 0 else []
    items = [{"id": 1, "type": kind, "props": ([] if kind == "iden" else [1]) + ([] if derived else [2]) + ([] if kind == "iden" else turns) + ([] if derived else color), "parts": [b"x"]}]
    refs = []
    if derived:
        items.append({"id": 2, "type": "hvc1", "props": [1, 2, *turns, *color]})
        refs.append(("dimg", 1, [2]))
    for every, n, more, ref in ((3, 3, [1], "thmb"), (5, 4, [1, 6], "auxl"), (7, 5, [1, 7], "auxl")):
        if key % every == 0:
            items.append({"id": n, "type": "hvc1", "props": more})
            refs.append((ref, n, [1]))
    if key % 2 == 0:
        items.append({"id": 6, "type": "Exif", "parts": [bytes([0, 0, 0, 2]) + b"zzMM" + str(key).encode()]})
    if key % 11 == 0:
        items.append({"id": 7, "type": "mime", "content_type": "application/rdf+xml", "parts": [f"<x>{key}</x>".encode()]})
    return w.still(items, props, refs)


def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), _info_file))
    out = it.info(c)
    return out.select("file_id", "kind", "width", "height", "bit_depth", "has_alpha", "has_exif", "has_xmp", "has_thumbnail", "has_gain_map", "color_primaries", "full_range", "rgb_bytes", "error")


IMAGE_INFO = """WITH a AS (SELECT p_partkey AS k, p_size AS s, p_size % 3 = 1 AS turned FROM part),
b AS (SELECT *, CASE WHEN s % 5 = 0 THEN s + 1 WHEN turned THEN s + 3 ELSE s + 8 END::BIGINT AS wd, CASE WHEN s % 5 = 0 THEN s + 2 WHEN turned THEN s + 8 ELSE s + 3 END::BIGINT AS ht FROM a)
SELECT k AS file_id, 'heic' AS kind, wd AS width, ht AS height, CASE k % 4 WHEN 0 THEN 8 + 2 * (k % 2) WHEN 1 THEN 8 + 2 * (k % 3 % 2) WHEN 2 THEN 12 ELSE 10 END::INT AS bit_depth,
k % 5 = 0 AS has_alpha, k % 2 = 0 AS has_exif, k % 11 = 0 AS has_xmp, k % 3 = 0 AS has_thumbnail, k % 7 = 0 AS has_gain_map, CASE WHEN k % 6 = 0 THEN 1 END::INT AS color_primaries,
CASE WHEN k % 6 = 0 THEN k % 2 = 1 END AS full_range, wd * ht * 3 AS rgb_bytes, NULL::VARCHAR AS error FROM b"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(key: int, name: str) -> bytes:
        props = [w.ispe(1, 1), w.icc(name.encode()), w.nclx(1, 1, 1, True)]
        return w.still([{"id": 1, "type": "hvc1", "props": [1, 2, 3][: 1 + key % 3]}, {"id": 2, "type": "Exif", "parts": [b"\0\0\0\xff" + b"bad"]}, {"id": 3, "type": "Exif", "parts": [bytes([0, 0, 0, key % 4]) + b"z" * (key % 4) + f"MM{key}".encode()]}, {"id": 4, "type": "mime", "content_type": "application/xmp", "parts": [name.encode(), b"!"], "idat": True}], props)

    c = Container(written(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), make))
    return it.metadata(c).select("file_id", *[F.col(k).cast("string").alias(k) for k in ("exif", "xmp", "icc")])


def heif_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by the data source, and read by it: what is told of them, how many bytes that took, and the payloads of one type."""
    heif.register(spark)
    files = written(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), _large_file)
    path = shared_folder(spark, "heif")
    files.select(F.format_string("%d/%d.heic", F.col("file_id") % 7, "file_id").alias("name"), "content").write.format("heif").mode("append").save(path)
    key = F.regexp_extract("file_id", r"(\d+)\.heic$", 1).cast("long")
    told = it.info(heif.container(spark, path)).select("file_id", "width", "height", "has_exif", "error")
    taken = spark.read.format("heif").load(path).select("file_id", "file_len", (F.col("bytes_read") < 2000).alias("few"))
    exif = heif.payloads(spark, path).where("item_type = 'Exif'").select("file_id", F.col("payload").cast("string").alias("payload"))
    return told.join(taken, "file_id").join(exif, "file_id", "left").select(key.alias("file_id"), "width", "height", "has_exif", "file_len", "few", "payload", "error")


def _large_file(key: int, name: str, nation: int) -> bytes:
    """A picture of some thousand bytes, and its Exif data behind."""
    body = bytes(4000 + key % 50)
    exif = [{"id": 2, "type": "Exif", "parts": [name.encode(), str(nation).encode()]}] if key % 3 else []
    return w.still([{"id": 1, "type": "hvc1", "props": [1, 2], "parts": [body]}, *exif], [w.ispe(key % 90 + 1, nation + 1), w.hvcc()])


HEIF_SOURCE = """SELECT c_custkey AS file_id, (c_custkey % 90 + 1)::BIGINT AS width, (c_nationkey + 1)::BIGINT AS height, c_custkey % 3 > 0 AS has_exif,
(4259 + c_custkey % 50 + CASE WHEN c_custkey % 3 > 0 THEN 50 + length(c_name) + length(c_nationkey::VARCHAR) ELSE 0 END)::BIGINT AS file_len, true AS few, CASE WHEN c_custkey % 3 > 0 THEN c_name || c_nationkey END AS payload, NULL::VARCHAR AS error FROM customer"""


METADATA = """SELECT c_custkey AS file_id, 'MM' || c_custkey AS exif, c_name || '!' AS xmp, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS icc FROM customer"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(key: int, n: int) -> bytes:
        items = [{"id": i, "type": "hvc1", "props": [1] if i % 3 else [1, 2]} for i in range(1, 12)]
        return w.still(items, [w.ispe(1, 1), w.auxc(ALPHA)], [("dimg", 1, [2 + n % 4, 3, 4, 5, 6]), ("dimg", 1, [7 + n % 3]), ("thmb", 8, [1]), ("thmb", 9, [2, 1]), ("auxl", 3, [1]), ("auxl", 10, [1]), ("auxl", 6, [2])])

    c = Container(written(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), make))
    a = it.references(c, "dimg", 6).select("file_id", F.lit("dimg").alias("what"), "no", F.col("to_id").alias("id"))
    b = it.thumbnails(c).where("target_id = 1").select("file_id", F.lit("thmb").alias("what"), "pos", "item_id")
    d = it.auxiliaries(c, ALPHA).where("target_id = 1").select("file_id", F.lit("auxl").alias("what"), "pos", "item_id")
    return a.unionAll(b).unionAll(d).select("file_id", "what", F.col("no").cast("int").alias("no"), "id")


REFERENCES = """SELECT s_suppkey AS file_id, what, no::INT AS no, id::BIGINT AS id FROM supplier,
LATERAL (VALUES ('dimg', 0, 2 + s_nationkey % 4), ('dimg', 1, 3), ('dimg', 2, 4), ('dimg', 3, 5), ('dimg', 4, 6), ('dimg', 5, 7 + s_nationkey % 3), ('thmb', 0, 8), ('thmb', 1, 9), ('auxl', 0, 3), ('auxl', 0, 10)) t(what, no, id)"""


def compact_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(key: int, size: int) -> bytes:
        return w.mini(size + 20, size + 10, key % 8 + 1, exif=b"\0\0\0\0MM" if key % 2 else b"", xmp=b"<x/>" if key % 3 == 0 else b"", alpha=b"a" if key % 5 == 0 else b"", icc_profile=b"profile" if key % 7 == 0 else b"", codec=w.hvcc(8 + 2 * (key % 3)), cicp=(9, 16, 9) if key % 4 == 0 else None)

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make))
    return it.info(c).select("file_id", "width", "height", "bit_depth", "has_alpha", "has_exif", "has_xmp", "color_primaries", "matrix_coefficients", "full_range")


COMPACT_IMAGES = """SELECT p_partkey AS file_id, CASE WHEN p_partkey % 8 + 1 >= 5 THEN p_size + 10 ELSE p_size + 20 END::BIGINT AS width, CASE WHEN p_partkey % 8 + 1 >= 5 THEN p_size + 20 ELSE p_size + 10 END::BIGINT AS height,
(8 + 2 * (p_partkey % 3))::INT AS bit_depth, p_partkey % 5 = 0 AS has_alpha, p_partkey % 2 = 1 AS has_exif, p_partkey % 3 = 0 AS has_xmp,
CASE WHEN p_partkey % 4 = 0 THEN 9 WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END::INT AS color_primaries, CASE WHEN p_partkey % 4 = 0 THEN 9 ELSE 6 END::INT AS matrix_coefficients, true AS full_range FROM part"""


# ---- sequences ----


def _sequence_file(key: int, orders: list[int]) -> bytes:
    n = len(orders)
    sizes, deltas = [10 + o % 7 for o in orders], [(1, 1 + o % 5) for o in orders]
    shifts = [(1, o % 3 * 2 - 1) for o in orders] if key % 2 else None
    sync = [i + 1 for i in range(0, n, 4)] if key % 3 else None
    starts, at = [], 32
    for i in range(0, n, 3):
        starts.append(at)
        at += sum(sizes[i : i + 3]) + 2
    total = sum(d for _, d in deltas)
    edits = [(2 * (total // 2), 2), (5, -1), (2 * total, 0)] if key % 5 == 0 else [(2 * total, 0)] if key % 5 == 1 else None
    tail = n % 3
    chunks = [(1, 3)] + ([(len(starts), tail)] if tail and len(starts) > 1 else [])
    if tail and len(starts) == 1:
        chunks = [(1, tail)]
    return w.movie([w.track(sizes, deltas, starts, chunks, shifts, sync, edits, loop=key % 5 == 1, timescale=500)], 1000, 6 * total, bytes(at - 32))


def _sequences(spark: SparkSession, sf_dir: str) -> Sequences:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    return Sequences(Container(written(orders, _sequence_file)))


_SAMPLES = """WITH o AS (SELECT o_custkey AS f, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT *, 10 + o % 7 AS size, 1 + o % 5 AS dur, coalesce(sum(1 + o % 5) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dt,
32 + coalesce(sum(10 + o % 7) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 * ((i - 1) // 3) AS off, f % 3 = 0 OR (i - 1) % 4 = 0 AS sync FROM o),
t AS (SELECT *, dt + CASE WHEN f % 2 = 1 THEN o % 3 * 2 - 1 ELSE 0 END AS ct FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ct, i) - 1 AS rank, max(CASE WHEN sync THEN i END) OVER (PARTITION BY f ORDER BY i) AS gop, sum(dur) OVER (PARTITION BY f) AS total, min(ct) OVER (PARTITION BY f) AS first FROM t),
e AS (SELECT f, 0 AS e, 0 AS cursor, total // 2 AS span, 2 AS at FROM (SELECT DISTINCT f, total FROM u) WHERE f % 5 = 0 UNION ALL SELECT f, 2, 2 * (total // 2) + 5, total, 0 FROM (SELECT DISTINCT f, total FROM u) WHERE f % 5 = 0
UNION ALL SELECT f, 0, 0, total, 0 FROM (SELECT DISTINCT f, total FROM u) WHERE f % 5 = 1),
fr AS (SELECT f, 0 AS e, rank, i, 2 * (ct - first) AS tm, 2 * dur AS d FROM u WHERE f % 5 > 1 UNION ALL SELECT u.f, e.e, u.rank, u.i, e.cursor + 2 * (u.ct - e.at), 2 * u.dur FROM u JOIN e ON u.f = e.f AND u.ct >= e.at AND u.ct - e.at < e.span)
"""


def sequence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).samples.select("file_id", "sample", F.col("offset").cast("long").alias("offset"), "size", "duration", "composition_time", "is_sync", F.col("rank").cast("long").alias("rank"), "gop")


def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single samples of sequences, among them numbers that they lack: none is unrolled."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    wanted = F.array(*[((F.col("file_id") * k) % 40 + 1) for k in (1, 3, 7, 11)])
    found = lookup(Container(written(orders, _sequence_file)), F.array_distinct(wanted))
    return found.select("file_id", F.col("wanted").alias("sample"), F.col("offset").cast("long").alias("offset"), "size", "duration", "decode_time", "composition_time")


SEQUENCE_SAMPLES = _SAMPLES + "SELECT f AS file_id, i AS sample, off::BIGINT AS offset, size::BIGINT AS size, dur::BIGINT AS duration, ct::BIGINT AS composition_time, sync AS is_sync, rank, gop FROM u"


SAMPLE_LOOKUP = _SAMPLES + """SELECT k.f AS file_id, k.i AS sample, off::BIGINT AS offset, size::BIGINT AS size, dur::BIGINT AS duration, dt::BIGINT AS decode_time, ct::BIGINT AS composition_time
FROM (SELECT DISTINCT f, (f * m) % 40 + 1 AS i FROM o, (VALUES (1), (3), (7), (11)) v(m)) k LEFT JOIN u ON u.f = k.f AND u.i = k.i"""


def sequence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).frames.select("file_id", F.col("frame").cast("long").alias("frame"), "sample", F.col("time").cast("long").alias("time"), "duration")


SEQUENCE_FRAMES = _SAMPLES + "SELECT f AS file_id, row_number() OVER (PARTITION BY f ORDER BY e, rank) - 1 AS frame, i AS sample, tm::BIGINT AS time, d::BIGINT AS duration FROM fr"


def sequence_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).info.select("file_id", "role", "frames", "timescale", F.col("duration").cast("long").alias("duration"), "repetitions", F.col("first_time").cast("long").alias("first_time"), F.col("last_time").cast("long").alias("last_time"), "dependent")


SEQUENCE_INFO = _SAMPLES + """, g AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY e, rank) AS n FROM fr)
SELECT g.f AS file_id, 'image' AS role, count(*) AS frames, 1000::BIGINT AS timescale, any_value(6 * x.total)::BIGINT AS duration, CASE WHEN g.f % 5 = 0 THEN 0 WHEN g.f % 5 = 1 THEN 3 ELSE 1 END::BIGINT AS repetitions,
arg_min(tm, n)::BIGINT AS first_time, arg_max(tm, n)::BIGINT AS last_time, any_value(x.dep) AS dependent FROM g JOIN (SELECT f, max(total) AS total, bool_or(NOT sync) AS dep FROM u GROUP BY f) x ON x.f = g.f GROUP BY g.f"""


def _movie_file(key: int, size: int) -> bytes:
    """Still images, movies alone, movies with alpha and thumbnail tracks, movies whose samples leave the file, and alpha out of step."""
    k = key % 5
    if k == 0:
        return w.still([{"id": 1, "type": "hvc1", "props": [1, 2]}], [w.ispe(size, size + 1), w.hvcc(10)])
    n = 1 + size % 4
    even = lambda delta, **how: w.track([4] * n, [(n, delta)], [32 if k != 3 else 10_000], [(1, n)], **how)
    tracks = [even(20, width=size + 2, height=size + 3)]
    if k in (2, 4):
        tracks.append(even(20 if k == 2 else 30, track_id=2, handler="auxv", alpha_of=1, width=size + 2, height=size + 3))
    if k == 2:
        tracks.append(even(20, track_id=3, width=2, height=2))
    return w.movie(tracks, 1000, 20 * n, bytes(40), brands=("avis", "mif1"))


def movie_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), _movie_file))
    return it.info(c).select("file_id", "kind", "width", "height", "bit_depth", "has_alpha", "has_thumbnail", "has_exif", "within_limits", "rgba_bytes", "error")


MOVIE_INFO = """WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 5 AS v FROM part)
SELECT k AS file_id, CASE WHEN v = 0 THEN 'heic' WHEN v IN (1, 2) THEN 'sequence' ELSE 'avif' END AS kind, CASE WHEN v = 0 THEN s WHEN v IN (1, 2) THEN s + 2 END::BIGINT AS width, CASE WHEN v = 0 THEN s + 1 WHEN v IN (1, 2) THEN s + 3 END::BIGINT AS height,
CASE WHEN v = 0 THEN 10 WHEN v IN (1, 2) THEN 8 END::INT AS bit_depth, CASE WHEN v < 3 THEN v = 2 END AS has_alpha, CASE WHEN v < 3 THEN v = 2 END AS has_thumbnail, CASE WHEN v < 3 THEN false END AS has_exif, CASE WHEN v < 3 THEN true END AS within_limits,
CASE WHEN v = 0 THEN s * (s + 1) * 4 WHEN v IN (1, 2) THEN (s + 2) * (s + 3) * 4 END::BIGINT AS rgba_bytes, CASE WHEN v > 2 THEN 'no primary item' END AS error FROM p"""


def sequence_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image, alpha and thumbnail tracks of movies, and whether alpha is in step with the image."""
    rows = Sequences(Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), _movie_file))).rows
    named = F.filter(F.array(*[F.struct(F.col(f"roles.{r}").cast("int").alias("track"), F.lit(r).alias("role")) for r in ("image", "alpha", "thumbnail")]), lambda r: r["track"].isNotNull())
    return rows.select("file_id", F.explode(named).alias("r"), "matches").select("file_id", "r.*", "matches")


SEQUENCE_ROLES = """SELECT p_partkey AS file_id, track::INT AS track, role, CASE p_partkey % 5 WHEN 2 THEN true WHEN 4 THEN false END AS matches FROM part, (VALUES (0, 'image'), (1, 'alpha'), (2, 'thumbnail')) v(track, role)
WHERE p_partkey % 5 > 0 AND (role = 'image' OR p_partkey % 5 = 2 OR role = 'alpha' AND p_partkey % 5 = 4)"""


def _mixed_file(key: int, size: int) -> bytes:
    """Still images, movies with alpha and a thumbnail, and still images beside a movie."""
    even = lambda n, delta, at, **how: w.track([4] * n, [(n, delta)], [at], [(1, n)], **how)
    still = w.still([{"id": 1 + key % 2, "type": "hvc1", "props": [1, 2]}], [w.ispe(size, size + 1), w.hvcc(10)], brands=("mif1", "msf1") if key % 3 == 2 else ("mif1", "heic"), primary=1 + key % 2)
    if key % 3 == 0:
        return still
    tracks = [even(4, 20, 32 + key % 5, width=size + 2, height=size + 3)]
    if key % 3 == 2:
        return still + w.movie(tracks, 1000, 80)[-len(w.box("moov", w.full("mvhd", 0, 0, bytes(16)), *tracks)) :]
    tracks += [even(4, 20, 32, track_id=2, handler="auxv", alpha_of=1, width=size + 2, height=size + 3), even(2, 40, 40, track_id=3, width=2, height=2)]
    return w.movie(tracks, 1000, 80, bytes(60))


def movie_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as items, alone and beside still images: what is told of them, where their payload stands, and what refers to them."""
    c = Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), _mixed_file))
    one = F.transform("nodes", lambda n: F.struct(n["item_id"].alias("item_id"), it.resolved(n).alias("r"), F.get(F.get(F.col("locations"), n["loc"])["parts"], F.lit(0)).alias("at"), F.get(F.filter("links", lambda x: x["from_id"] == n["item_id"]), F.lit(0)).alias("link")))
    rows = c.parsed.select("file_id", "primary_id", F.explode(one).alias("i"))
    return rows.select("file_id", "i.item_id", (F.col("i.item_id") == F.col("primary_id")).alias("is_primary"), "i.r.item_type", F.col("i.r.ispe.width").alias("width"), F.col("i.r.hvcc.bit_depth").alias("bit_depth"), F.col("i.at.at").cast("long").alias("at"), F.col("i.at.length").cast("long").alias("length"), F.get("i.link.targets", F.lit(0))["to_id"].alias("refers_to"))


MOVIE_ITEMS = """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS file_id, (1 + k % 2)::BIGINT AS item_id, true AS is_primary, 'hvc1' AS item_type, s::BIGINT AS width, 10::INT AS bit_depth, NULL::BIGINT AS at, NULL::BIGINT AS length, NULL::BIGINT AS refers_to FROM p WHERE k % 3 <> 1
UNION ALL SELECT k, 4294967295, false, 'hvc1', s + 2, 8, 32 + k % 5, 4, NULL FROM p WHERE k % 3 = 2
UNION ALL SELECT k, i, i = 1, 'hvc1', CASE WHEN i = 3 THEN 2 ELSE s + 2 END, 8, CASE i WHEN 1 THEN 32 + k % 5 WHEN 2 THEN 32 ELSE 40 END, 4, CASE WHEN i = 3 THEN 1 END FROM p, (VALUES (1), (2), (3)) v(i) WHERE k % 3 = 1"""


def decode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which items have to be decoded, with alpha, prediction, cycles, missing items and chains that are too long."""

    def make(key: int, nation: int) -> bytes:
        made = {1: [2, 3], 5: [1], 7: [99] if key % 2 else [5], 8: [7], 9: [8], 10: [9 - nation % 2]}
        items = [{"id": i, "type": "grid" if i == 1 else "iden" if i in made else "hvc1", "props": [1, 2] if i == 6 else [1]} for i in range(1, 11)]
        refs = [("dimg", i, to) for i, to in made.items()] + [("pred", 3, [4])] + ([("pred", 4, [3])] if key % 3 == 0 else []) + [("auxl", 6, [5]), ("auxl", 2, [9]), ("thmb", 4, [1])]
        return w.still(items, [w.ispe(1, 1), w.auxc(ALPHA)], refs)

    return derived.order(Container(written(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), make)))


DECODE_ORDER = """WITH v AS (SELECT s_suppkey AS file_id, s_nationkey AS n, i, s_suppkey % 3 = 0 AS round, s_suppkey % 2 = 1 AS lost FROM supplier, (SELECT unnest(range(1, 11)) AS i)),
l AS (SELECT *, CASE WHEN i IN (2, 6) THEN 0 WHEN i = 4 AND NOT round THEN 0 WHEN i = 3 AND NOT round THEN 1 WHEN i = 1 AND NOT round THEN 2 WHEN i = 5 AND NOT round THEN 3 WHEN i > 6 AND NOT round AND NOT lost THEN CASE i WHEN 10 THEN 7 - n % 2 ELSE i - 3 END END AS level FROM v)
SELECT file_id, i::BIGINT AS item_id, level::INT AS level, CASE WHEN level > 4 THEN 'nested too deep' WHEN level IS NOT NULL THEN NULL WHEN i = 7 AND lost THEN 'item 99 is missing' WHEN i > 7 AND lost THEN 'item ' || CASE i WHEN 10 THEN 9 - n % 2 ELSE i - 1 END || ' has no level' ELSE 'in a cycle, or over one' END AS error FROM l"""


def grid_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that a region of each grid needs, with their payloads; tiles of odd files are turned."""

    def make(key: int) -> bytes:
        rows, columns, tw, th = key % 3 + 1, key % 4 + 1, key % 5 + 3, 4
        width, height = columns * tw - key % 2, rows * th - 1
        grid = bytes([0, 0, rows - 1, columns - 1]) + width.to_bytes(2, "big") + height.to_bytes(2, "big")
        tiles = [{"id": i + 2, "type": "hvc1", "props": [1, 2, 3] if key % 2 else [1, 2], "parts": [f"{key}/{i}".encode()]} for i in range(rows * columns - (key % 11 == 0))]
        return w.still([{"id": 1, "type": "grid", "parts": [grid], "idat": key % 4 == 0}, *tiles], [w.ispe(th, tw) if key % 2 else w.ispe(tw, th), w.hvcc(), w.irot(1)], [("dimg", 1, [t["id"] for t in tiles])])

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), make))
    out = derived.region_tiles(c, F.col("file_id") % 7 - 1, F.col("file_id") % 3, F.col("file_id") % 7 + 6, F.col("file_id") % 3 + 5, payloads=True)
    return out.withColumn("payload", F.col("payload").cast("string"))


GRID_REGION = """WITH g AS (SELECT p_partkey AS k, p_partkey % 3 + 1 AS r, p_partkey % 4 + 1 AS c, p_partkey % 5 + 3 AS tw, 4 AS th, greatest(p_partkey % 7 - 1, 0) AS x0, p_partkey % 3 AS y0 FROM part),
h AS (SELECT *, least(k % 7 + 6, c * tw - k % 2) AS x1, least(k % 3 + 5, r * th - 1) AS y1 FROM g),
t AS (SELECT *, j * c + i AS no, greatest(i * tw, x0) AS ax, greatest(j * th, y0) AS ay, least((i + 1) * tw, x1) AS zx, least((j + 1) * th, y1) AS zy FROM h, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(3)) AS j) WHERE i < c AND j < r AND k % 11 > 0)
SELECT k AS file_id, 1::BIGINT AS item_id, no::INT AS no, (no + 2)::BIGINT AS tile_id, (ax - i * tw)::BIGINT AS source_x, (ay - j * th)::BIGINT AS source_y, (ax - x0)::BIGINT AS target_x, (ay - y0)::BIGINT AS target_y, (zx - ax)::BIGINT AS width, (zy - ay)::BIGINT AS height, NULL::VARCHAR AS error, k || '/' || no AS payload FROM t WHERE zx > ax AND zy > ay
UNION ALL SELECT k, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'the grid''s tiles are too many or too few', NULL FROM g WHERE k % 11 = 0"""


def box_scan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box_scan as a table function in SQL."""
    register_functions(spark)
    files = written(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _nation_file)
    return spark.sql("SELECT f.file_id, b.type, count(*) AS n, sum(CASE WHEN b.type = 'free' THEN b.content_len END) AS free_bytes FROM {files} f, LATERAL box_scan(f.content) b GROUP BY f.file_id, b.type", files=files)


def limited_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that are too large, need too much memory, or pack far more than they show."""

    def make(key: int) -> bytes:
        width = key % 30 + 1
        plane = bytes((key + x) % 256 for x in range(width)) * 10
        return w.unci_file(zlib.compress(plane + bytes(100_000 if key % 3 == 0 else 0)), width, 10, w.uncc([8]), (0,), [w.cmpc("zlib")])

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), make), Limits(width=20, memory=11_990))
    seen = it.info(c).select("file_id", "within_limits")
    return seen.join(pictures(c).select("file_id", F.length("data").cast("long").alias("bytes"), "error"), "file_id")


LIMITED_PICTURES = """WITH p AS (SELECT p_partkey AS k, p_partkey % 30 + 1 AS w FROM part)
SELECT k AS file_id, w <= 20 AS within_limits, CASE WHEN w <= 20 THEN 30 * w END::BIGINT AS bytes, CASE WHEN w > 24 THEN 'the file needs more memory than allowed' WHEN w > 20 THEN 'the image is too large' END AS error FROM p"""


# ---- pictures ----


def _value(key: int, c: int, x: int, y: int) -> int:
    return key * 7 + c * 50 + x * 40 + y * 10 + x * y


def _unci_variant(key: int) -> bytes:
    v = key % 10
    depth = {4: 10, 5: 5, 7: 10, 8: 10}.get(v, 8)
    planes = [[[_value(key, c, x, y) % (1 << depth) for x in range(4)] for y in range(4)] for c in range(3)]
    layout, tiles = {0: 0, 1: 1, 2: 3, 3: 4, 4: 0, 5: 1, 6: 0, 9: 4}.get(v, 0), (2, 1) if v == 3 else (2, 2) if v == 9 else (1, 1)
    more = [w.cmpc("zlib")] if v == 6 else []
    if v == 7:  # a block of four bytes for each pixel, the first component highest
        data = b"".join((planes[0][y][x] << 20 | planes[1][y][x] << 10 | planes[2][y][x]).to_bytes(4, "big") for y in range(4) for x in range(4))
        form = w.uncc([10] * 3, 1, 4, 0, 4)
    elif v == 8:  # two bytes for each sample, low end first, padded below
        data = b"".join((planes[c][y][x] << 6).to_bytes(2, "little") for c in range(3) for y in range(4) for x in range(4))
        form = w.uncc([10] * 3, 0, 2, 0x60)
    else:
        data = w.pack_samples(planes, [depth] * 3, layout, tiles)
        form = w.uncc([depth] * 3, layout, tiles=tiles)
    return w.unci_file(zlib.compress(data) if v == 6 else data, 4, 4, form, (4, 5, 6), more)


def unci_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), _unci_variant))
    return pixels(pictures(c)).select("file_id", "x", "y", "ch", "v")


_GRID = "FROM part, (SELECT unnest(range({w})) AS x), (SELECT unnest(range({h})) AS y), (SELECT unnest(range({c})) AS ch)"
UNCI_PIXELS = """WITH p AS (SELECT p_partkey AS k, x, y, ch, p_partkey * 7 + ch * 50 + x * 40 + y * 10 + x * y AS raw """ + _GRID.format(w=4, h=4, c=3) + """)
SELECT k AS file_id, x::INT AS x, y::INT AS y, ch::INT AS ch, CASE WHEN k % 10 IN (4, 7, 8) THEN (raw % 1024) >> 2 WHEN k % 10 = 5 THEN ((raw % 32) * 255 + 15) // 31 ELSE raw % 256 END::INT AS v FROM p"""


def packed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose samples are compressed whole or in units, with and without a zlib header."""

    def make(key: int) -> bytes:
        planes = [[[_value(key, c, x, y) % 256 for x in range(4)] for y in range(4)] for c in range(3)]
        data, kind = w.pack_samples(planes, [8] * 3, 0), "zlib" if key % 2 else "defl"
        n = (len(data), 16, 5, 4)[key % 4]
        units = []
        for at in range(0, len(data), n):
            z = zlib.compressobj(wbits=zlib.MAX_WBITS if key % 2 else -zlib.MAX_WBITS)
            units.append(z.compress(data[at : at + n]) + z.flush())
        return w.unci_file(b"".join(units), 4, 4, w.uncc([8] * 3), (4, 5, 6), [w.cmpc(kind)] + ([w.icef(map(len, units))] if key % 4 else []))

    return pixels(pictures(Container(written(table(spark, sf_dir, "part").select("p_partkey"), make)))).select("file_id", "x", "y", "ch", "v")


PACKED_PIXELS = "SELECT p_partkey AS file_id, x::INT AS x, y::INT AS y, ch::INT AS ch, ((p_partkey * 7 + ch * 50 + x * 40 + y * 10 + x * y) % 256)::INT AS v " + _GRID.format(w=4, h=4, c=3)


def chroma_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of half the chroma across, or across and down, in planes or with the two mixed; two matrices, full and limited range."""

    def make(key: int) -> bytes:
        rows = 2 if key % 2 else 4
        luma = bytes((key * 5 + x * 30 + y * 17) % 256 for y in range(4) for x in range(4))
        cb, cr = ([(key * (3 + c) + x * 90 + y * 25 + c * 40) % 256 for y in range(rows) for x in range(2)] for c in range(2))
        mixed = key % 4 > 1
        body = bytes(v for pair in zip(cb, cr, strict=True) for v in pair) if mixed else bytes(cb + cr)
        form = w.uncc([8] * 3, 2 if mixed else 0, sampling=1 + key % 2)
        return w.unci_file(luma + body, 4, 4, form, (1, 2, 3), [w.nclx(1, 13, 1 if key % 3 == 0 else 6, key % 5 > 1)])

    return pixels(pictures(Container(written(table(spark, sf_dir, "part").select("p_partkey"), make)))).select("file_id", "x", "y", "ch", "v")


CHROMA_PIXELS = """WITH p AS (SELECT p_partkey AS k, x, y, ch, ((p_partkey * 5 + x * 30 + y * 17) % 256)::INT AS lu, x // 2 AS cx, CASE WHEN p_partkey % 2 = 1 THEN y // 2 ELSE y END AS cy """ + _GRID.format(w=4, h=4, c=3) + """),
a AS (SELECT *, ((k * 3 + cx * 90 + cy * 25) % 256)::INT AS cb, ((k * 4 + cx * 90 + cy * 25 + 40) % 256)::INT AS cr, k % 5 > 1 AS f FROM p),
b AS (SELECT *, greatest(16, least(235, lu)) - 16 AS ly, greatest(16, least(240, cb)) - 128 AS lb, greatest(16, least(240, cr)) - 128 AS lr, cb - 128 AS fb, cr - 128 AS fr,
CASE WHEN f THEN CASE WHEN k % 3 = 0 THEN [403, -48, -120, 475] ELSE [359, -88, -183, 454] END ELSE CASE WHEN k % 3 = 0 THEN [14744, -1754, -4383, 17373] ELSE [13126, -3222, -6686, 16591] END END AS q FROM a),
c AS (SELECT *, CASE ch WHEN 0 THEN q[1] * CASE WHEN f THEN fr ELSE lr END WHEN 1 THEN q[2] * CASE WHEN f THEN fb ELSE lb END + q[3] * CASE WHEN f THEN fr ELSE lr END ELSE q[4] * CASE WHEN f THEN fb ELSE lb END END AS add FROM b)
SELECT k AS file_id, x::INT AS x, y::INT AS y, ch::INT AS ch, greatest(0, least(255, CASE WHEN f THEN lu + ((add + 128) >> 8) ELSE (ly * 9576 + add + 4096) >> 13 END))::INT AS v FROM c"""


def role_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary images that are mirrored copies of another item, their thumbnails and their gain maps."""

    def make(key: int) -> bytes:
        plane = lambda width, height, n: w.pack_samples([[[(key * n + x * 20 + y * 7) % 256 for x in range(width)] for y in range(height)]], [8], 0)
        items = [{"id": 1, "type": "iden", "props": [6]}, {"id": 2, "type": "unci", "props": [1, 4, 5], "parts": [plane(4, 3, 1)]}]
        items += [{"id": 3, "type": "unci", "props": [2, 4, 5], "parts": [plane(2, 2, 3)]}, {"id": 4, "type": "unci", "props": [3, 4, 5, 7], "parts": [plane(3, 1, 5)]}]
        return w.still(items, [w.ispe(4, 3), w.ispe(2, 2), w.ispe(3, 1), w.uncc([8]), w.cmpd(0), w.imir(1), w.auxc(GAIN)], [("dimg", 1, [2]), ("thmb", 3, [1]), ("auxl", 4, [1])])

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), make))
    return pixels(pictures(c, roles=("primary", "thumbnail", "gain_map"))).where("ch = 0").select("file_id", "role", "x", "y", "v")


ROLE_PIXELS = """SELECT p_partkey AS file_id, role, x::INT AS x, y::INT AS y, ((p_partkey * n + CASE WHEN n = 1 THEN 3 - x ELSE x END * 20 + y * 7) % 256)::INT AS v
FROM part, (VALUES ('primary', 1, 4, 3), ('thumbnail', 3, 2, 2), ('gain_map', 5, 3, 1)) r(role, n, w, h), (SELECT unnest(range(4)) AS x), (SELECT unnest(range(3)) AS y) WHERE x < w AND y < h"""


def turned_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 x 4 pictures cut to 3 x 2 where the key is odd, then turned key % 4 times against the clock, then mirrored if key % 3."""

    def make(key: int) -> bytes:
        planes = [[[(key + c * 60 + x * 12 + y * 3) % 256 for x in range(5)] for y in range(4)] for c in range(3)]
        steps = ([w.clap(3, 2)] if key % 2 else []) + [w.irot(key % 4)] + ([w.imir(key % 3 - 1)] if key % 3 else [])
        return w.unci_file(w.pack_samples(planes, [8] * 3, 1), 5, 4, w.uncc([8] * 3, 1), (4, 5, 6), steps)

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), make))
    return pixels(pictures(c)).select("file_id", "x", "y", "ch", "v")


TURNED_PIXELS = """WITH p AS (SELECT p_partkey AS k, x, y, ch, (p_partkey + ch * 60 + x * 12 + y * 3) % 256 AS v """ + _GRID.format(w=5, h=4, c=3) + """),
a AS (SELECT k, ch, v, x - (k % 2) AS x, y - (k % 2) AS y, CASE WHEN k % 2 = 1 THEN 3 ELSE 5 END AS w, CASE WHEN k % 2 = 1 THEN 2 ELSE 4 END AS h FROM p WHERE k % 2 = 0 OR (x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2)),
b AS (SELECT k, ch, v, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN w - 1 - x ELSE h - 1 - y END AS x, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN w - 1 - x WHEN 2 THEN h - 1 - y ELSE x END AS y,
CASE WHEN k % 2 = 1 THEN h ELSE w END AS w, CASE WHEN k % 2 = 1 THEN w ELSE h END AS h FROM a)
SELECT k AS file_id, CASE WHEN k % 3 = 2 THEN w - 1 - x ELSE x END::INT AS x, CASE WHEN k % 3 = 1 THEN h - 1 - y ELSE y END::INT AS y, ch::INT AS ch, v::INT AS v FROM b"""


def alpha_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 pictures with alpha of 2 x 3 samples, as bgra."""

    def make(key: int) -> bytes:
        planes = [[[(key + c * 60 + x * 12 + y * 3) % 256 for x in range(4)] for y in range(4)] for c in range(3)]
        alpha = [[(key + 100 * x + 10 * y) % 256 for x in range(2)] for y in range(3)]
        extra = [{"id": 2, "type": "unci", "props": [4, 5, 6, 7], "parts": [w.pack_samples([alpha], [8], 0)]}]
        return w.unci_file(w.pack_samples(planes, [8] * 3, 0), 4, 4, w.uncc([8] * 3, 0), (4, 5, 6), (), extra, [w.ispe(2, 3), w.uncc([8]), w.cmpd(0), w.auxc(ALPHA)], [("auxl", 2, [1])])

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), make))
    return pixels(pictures(c, "bgra")).select("file_id", "x", "y", "ch", "v")


ALPHA_PIXELS = "SELECT p_partkey AS file_id, x::INT AS x, y::INT AS y, ch::INT AS ch, CASE WHEN ch = 3 THEN (p_partkey + 100 * (x * 2 // 4) + 10 * (y * 3 // 4)) % 256 ELSE (p_partkey + (2 - ch) * 60 + x * 12 + y * 3) % 256 END::INT AS v " + _GRID.format(w=4, h=4, c=4)


def overlay_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey 8 x 6 canvases with two grey 4 x 4 layers, the second partly outside."""

    def make(key: int) -> bytes:
        layer = lambda n: w.pack_samples([[[(key * n + x + 10 * y) % 256 for x in range(4)] for y in range(4)]], [8], 0)
        body = bytes([0, 0]) + (key % 200 << 8).to_bytes(2, "big") + bytes(6) + (8).to_bytes(2, "big") + (6).to_bytes(2, "big") + b"".join(v.to_bytes(2, "big", signed=True) for v in (1, 1, 6, -2 + key % 3))
        items = [{"id": 1, "type": "iovl", "props": [4], "parts": [body]}, {"id": 2, "type": "unci", "props": [1, 2, 3], "parts": [layer(1)]}, {"id": 3, "type": "unci", "props": [1, 2, 3], "parts": [layer(3)]}]
        return w.still(items, [w.ispe(4, 4), w.uncc([8]), w.cmpd(0), w.ispe(8, 6)], [("dimg", 1, [2, 3])])

    c = Container(written(table(spark, sf_dir, "part").select("p_partkey"), make))
    return pixels(pictures(c)).where("ch = 1").select("file_id", "x", "y", "v")


OVERLAY_PIXELS = """SELECT p_partkey AS file_id, x::INT AS x, y::INT AS y, CASE WHEN x >= 6 AND y + 2 - p_partkey % 3 BETWEEN 0 AND 3 THEN (p_partkey * 3 + x - 6 + 10 * (y + 2 - p_partkey % 3)) % 256
WHEN x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 4 THEN (p_partkey + x - 1 + 10 * (y - 1)) % 256 ELSE p_partkey % 200 END::INT AS v """ + _GRID.format(w=8, h=6, c=1)


def unsupported_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), _info_file))
    return pictures(c, roles=("primary", "thumbnail")).select("file_id", "role", "error")


UNSUPPORTED_PICTURES = """SELECT p_partkey AS file_id, 'primary' AS role, CASE p_partkey % 4 WHEN 0 THEN 'hevc pixels are unsupported' WHEN 1 THEN 'av1 pixels are unsupported' WHEN 2 THEN 'the data end too early' ELSE 'hevc pixels are unsupported' END AS error FROM part
UNION ALL SELECT p_partkey, 'thumbnail', 'hevc pixels are unsupported' FROM part WHERE p_partkey % 3 = 0"""


def image_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of parts against their neighbours' by key."""

    def make(key: int) -> bytes:
        planes = [[[(key * (c + 1) + x * 12 + y * 3) % 256 for x in range(4)] for y in range(4)] for c in range(3)]
        return w.unci_file(w.pack_samples(planes, [8] * 3, 0), 4, 4, w.uncc([8] * 3, 0), (4, 5, 6))

    p = pictures(Container(written(table(spark, sf_dir, "part").select("p_partkey"), make)))
    pairs = F.array(*[F.struct((F.col("file_id") - n).alias("pair"), F.lit(n).alias("side")) for n in (0, 1)])
    met = metrics.paired(p, pairs, ["width", "height", "format", "data"], "file_id")
    return metrics.differences(met, "file_id").select("file_id", "n", "sse", "max_diff", "n_diff", "mse")


IMAGE_DIFFERENCE = """WITH p AS (SELECT p_partkey AS k, x, y, ch, (p_partkey * (ch + 1) + x * 12 + y * 3) % 256 AS v """ + _GRID.format(w=4, h=4, c=3) + """)
SELECT a.k AS file_id, count(*) AS n, sum((a.v - b.v) * (a.v - b.v))::BIGINT AS sse, max(abs(a.v - b.v))::BIGINT AS max_diff, count(*) FILTER (a.v <> b.v) AS n_diff, sum((a.v - b.v) * (a.v - b.v))::DOUBLE / count(*) AS mse
FROM p a JOIN p b ON b.k = a.k + 1 AND a.x = b.x AND a.y = b.y AND a.ch = b.ch GROUP BY a.k"""


def _planes_file(key: int, changed: bool) -> bytes:
    """4 x 4 pictures: 8 bits with chroma of half size, or 10 bits; changed ones differ in a luma sample of every third and a chroma sample
    of every fifth."""
    depth, small = (10, 4) if key % 2 else (8, 2)
    planes = [[[(key * (c + 3) + x * 90 + y * 25 + c * 40) % (1 << depth) for x in range(n)] for y in range(n)] for c, n in enumerate((4, small, small))]
    planes[0][1][2] ^= changed and key % 3 == 0
    planes[1][0][1] ^= 3 * (changed and key % 5 == 0)
    data = w.pack_samples(planes, [10] * 3, 0) if key % 2 else bytes(v for p in planes for row in p for v in row)
    return w.unci_file(data, 4, 4, w.uncc([depth] * 3, 0, sampling=0 if key % 2 else 2), (1, 2, 3))


def native_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes at the depth of their samples, with their digests, against those of changed copies."""
    of = lambda changed: planes(Container(written(table(spark, sf_dir, "part").select("p_partkey"), lambda key: _planes_file(key, changed)))).where("error is null")
    return metrics.plane_differences(of(False), of(True), ["file_id"], digests=True).where("md5 is not null").select("file_id", "plane", "depth", "n", "sse", "max_diff", "md5_equal", "md5")


NATIVE_PLANES = """WITH s AS (SELECT p_partkey AS k, c, ['y', 'cb', 'cr'][c + 1] AS plane, p_partkey % 2 = 1 AS deep, x, y, (p_partkey * (c + 3) + x * 90 + y * 25 + c * 40) % CASE WHEN p_partkey % 2 = 1 THEN 1024 ELSE 256 END AS v
FROM part, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS y) WHERE c = 0 OR p_partkey % 2 = 1 OR x < 2 AND y < 2),
d AS (SELECT *, CASE WHEN c = 0 AND x = 2 AND y = 1 AND k % 3 = 0 THEN 1 WHEN c = 1 AND x = 1 AND y = 0 AND k % 5 = 0 THEN abs(xor(v, 3) - v) ELSE 0 END AS diff FROM s)
SELECT k AS file_id, plane, any_value(CASE WHEN deep THEN 10 ELSE 8 END)::INT AS depth, count(*) AS n, sum(diff * diff)::BIGINT AS sse, max(diff)::BIGINT AS max_diff, max(diff) = 0 AS md5_equal,
md5(unhex(string_agg(printf('%02X', (v % 256)::INT) || CASE WHEN deep THEN printf('%02X', (v // 256)::INT) ELSE '' END, '' ORDER BY y, x))) AS md5 FROM d GROUP BY k, plane"""


def strided_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with rows at a stride of the caller's, which may be too small."""

    def make(key: int) -> bytes:
        width = key % 3 + 2
        values = [[[(key * 7 + c * 50 + x * 40 + y * 10) % 256 for x in range(width)] for y in range(3)] for c in range(3)]
        return w.unci_file(w.pack_samples(values, [8] * 3, 1), width, 3, w.uncc([8] * 3, 1), (4, 5, 6))

    stride = F.col("file_id") % 9 + 6
    out = at_stride(pictures(Container(written(table(spark, sf_dir, "part").select("p_partkey"), make))), stride)
    return out.select("file_id", "stride", needed_bytes(F.col("width"), F.col("height"), F.col("format"), stride).alias("needed"), F.length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"), "error")


STRIDED_PICTURES = """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 + 2 AS w, p_partkey % 9 + 6 AS stride FROM part),
v AS (SELECT k, y, string_agg(printf('%02X', ((k * 7 + ch * 50 + x * 40 + y * 10) % 256)::INT), '' ORDER BY x, ch) AS line FROM p, (SELECT unnest(range(4)) AS x), (SELECT unnest(range(3)) AS y), (SELECT unnest(range(3)) AS ch) WHERE x < w GROUP BY k, y)
SELECT p.k AS file_id, CASE WHEN stride >= 3 * w THEN stride END::INT AS stride, CASE WHEN stride >= 3 * w THEN 2 * stride + 3 * w END::BIGINT AS needed, CASE WHEN stride >= 3 * w THEN 2 * stride + 3 * w END::BIGINT AS n_bytes,
CASE WHEN stride >= 3 * any_value(w) THEN md5(unhex(string_agg(CASE WHEN y < 2 THEN line || repeat('00', (stride - 3 * w)::INT) ELSE line END, '' ORDER BY y))) END AS md5, CASE WHEN stride < 3 * w THEN 'the stride is too small' END AS error FROM p JOIN v ON v.k = p.k GROUP BY p.k, p.w, p.stride"""


def thumb_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of pictures against expected ones, of which a byte is off, or the width."""

    def make(key: int) -> bytes:
        plane = [[(key * 11 + x * x + 5 * y) % 256 for x in range(20)] for y in range(18)]
        return w.unci_file(w.pack_samples([plane], [8], 0), 20, 18, w.uncc([8]), (0,))

    ours = metrics.thumbs(pictures(Container(written(table(spark, sf_dir, "supplier").select("s_suppkey"), make))))
    first = F.conv(F.hex(F.substring("means", 1, 1)), 16, 10).cast("int")
    moved = F.unhex(F.lpad(F.hex((first + F.col("file_id") % 60) % 256), 2, "0"))
    expected = ours.select("file_id", F.when(F.col("file_id") % 7 == 0, 21).otherwise(F.col("width")).alias("width"), "height", F.concat(moved, F.expr("substring(means, 2)")).alias("means"))
    return metrics.thumb_verdict(ours, expected, ["file_id"], gate=1.0).select("file_id", "ok", F.round("mse", 6).alias("mse"), "max_diff", "detail")


THUMB_VERDICTS = """WITH s AS (SELECT s_suppkey AS k, (s_suppkey * 11 % 256)::INT AS v FROM supplier), d AS (SELECT *, abs((v + k % 60) % 256 - v)::INT AS d, k % 7 = 0 AS wide FROM s)
SELECT k AS file_id, NOT wide AND d * d / 768.0 <= 1 AS ok, CASE WHEN NOT wide THEN round(d * d / 768.0, 6) END::DOUBLE AS mse, CASE WHEN NOT wide THEN d END::INT AS max_diff, CASE WHEN wide THEN 'size 20x18 != 21x18' END AS detail FROM d"""


def best_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_time(table(spark, sf_dir, "lineitem").withColumn("ms", F.col("l_quantity") + F.col("l_linenumber")), "l_orderkey", "ms")


BEST_TIMES = "SELECT l_orderkey, min(l_quantity + l_linenumber) AS best_ms FROM lineitem GROUP BY l_orderkey"


def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of pictures as files, and the hash of the samples of their middle channel."""

    def make(key: int) -> bytes:
        planes = [[[_value(key, c, x, y) % 256 for x in range(4)] for y in range(4)] for c in range(3)]
        return w.unci_file(w.pack_samples(planes, [8] * 3, 1), 4, 4, w.uncc([8] * 3, 1), (4, 5, 6))

    p = pictures(Container(written(table(spark, sf_dir, "supplier").select("s_suppkey"), make)))
    middle = pixels(p).where("ch = 1").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("samples"))
    return metrics.netpbm(p).select("file_id", F.length("ppm").alias("n_bytes"), F.md5("ppm").alias("md5")).join(metrics.plane_hash(middle, "file_id", "samples").withColumn("hash", F.col("hash").cast("string")), "file_id")


PICTURE_HASHES = """WITH p AS (SELECT s_suppkey AS k, x, y, ch, (s_suppkey * 7 + ch * 50 + x * 40 + y * 10 + x * y) % 256 AS v """ + _GRID.format(w=4, h=4, c=3).replace("FROM part", "FROM supplier") + """)
SELECT k AS file_id, (11 + count(*))::INT AS n_bytes, md5(unhex('50360A3420340A3235350A' || string_agg(printf('%02X', v::INT), '' ORDER BY y, x, ch))) AS md5,
list_reduce(list_prepend(14695981039346656037::HUGEINT, list(v::HUGEINT ORDER BY y, x) FILTER (ch = 1)), lambda h, v: xor(h, v) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT)::VARCHAR AS hash FROM p GROUP BY k"""


def box_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(key: int) -> bytes:
        plane = [[(key * 11 + x * x + 5 * y) % 256 for x in range(20)] for y in range(18)]
        return w.unci_file(w.pack_samples([plane], [8], 0), 20, 18, w.uncc([8]), (0,))

    means = metrics.thumbs(pictures(Container(written(table(spark, sf_dir, "supplier").select("s_suppkey"), make))))
    each = means.select("file_id", "means", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    v = F.conv(F.hex(F.substring("means", F.col("i") * 3 + 1, F.lit(1))), 16, 10).cast("int")
    return each.select("file_id", (F.col("i") % 16).alias("cx"), F.floor(F.col("i") / 16).cast("int").alias("cy"), v.alias("v"))


BOX_MEANS = """WITH p AS (SELECT s_suppkey AS k, x, y, (s_suppkey * 11 + x * x + 5 * y) % 256 AS v FROM supplier, (SELECT unnest(range(20)) AS x), (SELECT unnest(range(18)) AS y)), t AS (SELECT unnest(range(16)) AS t)
SELECT k AS file_id, a.t::INT AS cx, b.t::INT AS cy, ((sum(v) + count(*) // 2) // count(*))::INT AS v FROM p JOIN t a ON a.t * 20 // 16 <= x AND x < (a.t + 1) * 20 // 16 JOIN t b ON b.t * 18 // 16 <= y AND y < (b.t + 1) * 18 // 16 GROUP BY k, a.t, b.t"""


def annexb_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(key: int, n: int) -> bytes:
        return b"".join((b"\0" if i % 2 else b"") + b"\0\0\1" + bytes([(key + i) % 64 << 1, 1, 0x80 if i % 2 == 0 else 0x7F]) + b"u" * (key % 5 + i) for i in range(1 + n % 4))

    got = metrics.annexb_units(written(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), make), "file_id", "content")
    return got.select("file_id", "no", "nal_type", "first_slice", F.length("unit").alias("n_bytes"))


ANNEXB_UNITS = """SELECT s_suppkey AS file_id, i::INT AS no, ((s_suppkey + i) % 64)::INT AS nal_type, (s_suppkey + i) % 64 < 32 AND i % 2 = 0 AS first_slice, (3 + s_suppkey % 5 + i)::INT AS n_bytes
FROM supplier, LATERAL (SELECT unnest(range(1 + s_nationkey % 4)) AS i)"""


def coded_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, depths, colour, tiles and slices from the parameter sets and slice headers of HEVC items."""
    address_bits = lambda width, height: (-(-width // 32) * -(-height // 32) - 1).bit_length()

    def make(key: int, size: int) -> bytes:
        nals = [w.hevc_sps(64 + 8 * size, 48, (key % 3, 0, 0, key % 2), 8 + 2 * (key % 3), [([-1], [1]), ([-2], [])], (key % 2, 1 + key % 9, 13, 6) if key % 4 else None), w.hevc_pps((1 + key % 3, 1 + key % 2))]
        parts = [w.hevc_slice(19, 2)] + [w.hevc_slice(1, i % 3, key % 256, first=False, address=1, which=i % 2, address_bits=address_bits(64 + 8 * size, 48)) for i in range(key % 5)]
        return w.still([{"id": 1, "type": "hvc1", "props": [1, 2], "parts": [b"".join(len(p).to_bytes(4, "big") + p for p in parts)]}], [w.ispe(8, 8), w.hvcc(8, nals)])

    got = streams.coded_items(Container(written(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make)))
    return got.select("file_id", "width", "height", "bit_depth", "full_range", "primaries", "tile_columns", "tile_rows", "slices", "slice_types", "error")


CODED_STREAMS = """SELECT p_partkey AS file_id, (64 + 8 * p_size - 2 * (p_partkey % 3))::INT AS width, (48 - 2 * (p_partkey % 2))::INT AS height, (8 + 2 * (p_partkey % 3))::INT AS bit_depth, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 2 = 1 END AS full_range,
CASE WHEN p_partkey % 4 > 0 THEN 1 + p_partkey % 9 END::INT AS primaries, (1 + p_partkey % 3)::INT AS tile_columns, (1 + p_partkey % 2)::INT AS tile_rows, (1 + p_partkey % 5)::INT AS slices, substr('IBPIB', 1, (1 + p_partkey % 5)::INT) AS slice_types, NULL::VARCHAR AS error FROM part"""


# ---- expressions ----


def expr_ycc_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 256).cast("int").alias("y"), ((F.col("l_partkey") * 13) % 256).cast("int").alias("cb"), ((F.col("l_suppkey") * 29 + F.col("l_linenumber") * 31) % 256).cast("int").alias("cr"), F.element_at(F.array(*map(F.lit, (0, 1, 2, 5, 6, 9, 99))), (F.col("l_orderkey") % 7 + 1).cast("int")).alias("m"), (F.col("l_linenumber") % 2 == 0).alias("full"))
    rgb = colour.to_rgb(F.col("y"), F.col("cb"), F.col("cr"), colour.used_matrix(F.col("m"), F.lit(3)), F.col("full"))
    return t.select("l_orderkey", "l_linenumber", rgb.alias("p")).groupBy("l_orderkey").agg(F.sum("p.r").alias("r"), F.sum("p.g").alias("g"), F.sum("p.b").alias("b"))


EXPR_YCC_RGB = """WITH a AS (SELECT l_orderkey AS k, ((l_orderkey * 7 + l_linenumber) % 256)::INT AS y, ((l_partkey * 13) % 256)::INT AS cb, ((l_suppkey * 29 + l_linenumber * 31) % 256)::INT AS cr, [0, 1, 2, 5, 6, 9, 99][(l_orderkey % 7 + 1)::INT] AS m, l_linenumber % 2 = 0 AS f FROM lineitem),
b AS (SELECT *, CASE WHEN m IN (0, 1, 9) THEN m ELSE 6 END AS mm, greatest(16, least(235, y)) - 16 AS ly, greatest(16, least(240, cb)) - 128 AS lb, greatest(16, least(240, cr)) - 128 AS lr, cb - 128 AS fb, cr - 128 AS fr FROM a),
c AS (SELECT *, CASE WHEN f THEN CASE mm WHEN 1 THEN [403, -48, -120, 475] WHEN 9 THEN [377, -42, -146, 482] ELSE [359, -88, -183, 454] END ELSE CASE mm WHEN 1 THEN [14744, -1754, -4383, 17373] WHEN 9 THEN [13806, -1541, -5349, 17615] ELSE [13126, -3222, -6686, 16591] END END AS q FROM b),
d AS (SELECT k, CASE WHEN mm = 0 THEN cr WHEN f THEN y + ((q[1] * fr + 128) >> 8) ELSE (ly * 9576 + q[1] * lr + 4096) >> 13 END AS r, CASE WHEN mm = 0 THEN y WHEN f THEN y + ((q[2] * fb + q[3] * fr + 128) >> 8) ELSE (ly * 9576 + q[2] * lb + q[3] * lr + 4096) >> 13 END AS g,
CASE WHEN mm = 0 THEN cb WHEN f THEN y + ((q[4] * fb + 128) >> 8) ELSE (ly * 9576 + q[4] * lb + 4096) >> 13 END AS b FROM c)
SELECT k AS l_orderkey, sum(greatest(0, least(255, r)))::BIGINT AS r, sum(greatest(0, least(255, g)))::BIGINT AS g, sum(greatest(0, least(255, b)))::BIGINT AS b FROM d GROUP BY k"""


def expr_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 16 + 1).cast("int").alias("d"), (F.col("l_orderkey") * 97 + F.col("l_suppkey")).alias("n"))
    v = (F.col("n") % colour.left(F.lit(1), F.col("d"))).cast("int")
    t = t.withColumn("v", v)
    tile = colour.tile_origin(F.col("l_linenumber"), F.lit(3), F.col("d"), F.col("d") + 1)
    return t.select("l_orderkey", "l_linenumber", colour.to_8_bits(F.col("v"), F.col("d")).alias("v8"), colour.alpha_sample(F.col("v"), F.col("d"), F.lit(10)).alias("a10"), tile["x"].cast("int").alias("tx"), tile["y"].cast("int").alias("ty"), colour.nearest(F.col("d"), F.lit(17), F.col("l_linenumber") + 4).cast("int").alias("near"), rescale(F.col("n").cast("decimal(20,0)"), F.col("d").cast("bigint"), F.lit(48000).cast("bigint")).cast("long").alias("ticks")).dropDuplicates(["l_orderkey", "l_linenumber", "v8", "a10", "ticks"])


EXPR_SAMPLES = """WITH a AS (SELECT l_orderkey, l_linenumber, (l_partkey % 16 + 1)::INT AS d, l_orderkey * 97 + l_suppkey AS n FROM lineitem), b AS (SELECT *, (n % (1 << d))::INT AS v FROM a)
SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN d >= 8 THEN (v >> (d - 8)) & 255 ELSE (v * 255 + ((1 << d) - 1) // 2) // ((1 << d) - 1) END::INT AS v8, CASE WHEN d <= 10 THEN v << (10 - d) ELSE v >> (d - 10) END::INT AS a10,
(l_linenumber % 3 * d)::INT AS tx, (l_linenumber // 3 * (d + 1))::INT AS ty, least(d * (l_linenumber + 4) // 17, l_linenumber + 3)::INT AS near, ((n // d) * 48000 + (n % d) * 48000 // d)::BIGINT AS ticks FROM b"""


def corpus_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("root"), F.concat(F.lit("/x/"), F.col("p_partkey").cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))).alias("path"))
    return metrics.first_of_each_name(files, "root", "path")


CORPUS_PICK = """WITH f AS (SELECT p_partkey, p_brand AS root, '/x/' || p_partkey || '/' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS path FROM part)
SELECT p_partkey, root, path FROM f QUALIFY row_number() OVER (PARTITION BY lower(regexp_extract(path, '[^/]*$')) ORDER BY root, path) = 1"""


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_quantity")).alias("ours"), F.max(F.col("l_partkey") % 40 + 1).cast("double").alias("theirs"))
    return metrics.slowest(t, "ours", "theirs").select("l_orderkey", "ours", "theirs", F.round("percent", 6).alias("percent"))


BENCH_SUMMARY = """WITH t AS (SELECT l_orderkey, min(l_quantity) AS ours, max(l_partkey % 40 + 1)::DOUBLE AS theirs FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, ours, theirs, round((ours - theirs) / theirs * 100, 6) AS percent FROM t WHERE abs(ours - theirs) >= 2 ORDER BY (ours - theirs) / theirs * 100 DESC, l_orderkey LIMIT 10"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return t.select("o_orderkey", metrics.verdict(k % 7 != 0, k % 5 != 0, k % 11 != 0, F.col("o_totalprice") % 16).alias("verdict")).groupBy("verdict").count().withColumnRenamed("count", "n")


VERDICTS = """SELECT CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'both_fail' WHEN o_orderkey % 7 = 0 THEN 'ours_fail' WHEN o_orderkey % 5 = 0 THEN 'theirs_fail' WHEN o_orderkey % 11 = 0 THEN 'size_mismatch' WHEN o_totalprice % 16 <= 8 THEN 'match' ELSE 'other' END AS verdict, count(*) AS n FROM orders GROUP BY 1"""


ALL = (
    (file_kind, FILE_KIND), (box_scan, BOX_SCAN), (order_items, ORDER_ITEMS), (image_info, IMAGE_INFO), (metadata, METADATA), (heif_source, HEIF_SOURCE), (references, REFERENCES), (compact_images, COMPACT_IMAGES),
    (sequence_samples, SEQUENCE_SAMPLES), (sample_lookup, SAMPLE_LOOKUP), (sequence_frames, SEQUENCE_FRAMES), (sequence_info, SEQUENCE_INFO), (movie_info, MOVIE_INFO), (movie_items, MOVIE_ITEMS), (decode_order, DECODE_ORDER), (grid_region, GRID_REGION), (box_scan_sql, BOX_SCAN), (limited_pictures, LIMITED_PICTURES), (sequence_roles, SEQUENCE_ROLES),
    (unci_pixels, UNCI_PIXELS), (packed_pixels, PACKED_PIXELS), (chroma_pixels, CHROMA_PIXELS), (role_pixels, ROLE_PIXELS), (turned_pixels, TURNED_PIXELS), (alpha_pixels, ALPHA_PIXELS), (overlay_pixels, OVERLAY_PIXELS), (unsupported_pictures, UNSUPPORTED_PICTURES),
    (image_difference, IMAGE_DIFFERENCE), (native_planes, NATIVE_PLANES), (strided_pictures, STRIDED_PICTURES), (thumb_verdicts, THUMB_VERDICTS), (best_times, BEST_TIMES), (picture_hashes, PICTURE_HASHES), (box_means, BOX_MEANS), (annexb_units, ANNEXB_UNITS), (coded_streams, CODED_STREAMS), (expr_ycc_rgb, EXPR_YCC_RGB), (expr_samples, EXPR_SAMPLES), (corpus_pick, CORPUS_PICK), (bench_summary, BENCH_SUMMARY), (verdicts, VERDICTS),
)
QUERIES = {f.__name__: shipped(f) for f, _ in ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in ALL}
