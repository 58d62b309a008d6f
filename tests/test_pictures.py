"""Uncompressed decoding, geometry, colour and measures."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from boxloom.functions import colour
from boxloom.operators import frames as fr
from boxloom.operators import metrics, unci
from boxloom.operators.decode import grid_layout, overlay_layout, pictures
from boxloom.sources import writer as w
from boxloom.sources.properties import parse_property
from boxloom.sources.tables import Container


def layout(*args, **how):
    return parse_property("uncC", w.uncc(*args, **how)[8:])["uncc"]


@pytest.mark.parametrize(("depths", "interleave", "tiles"), list(itertools.product([(8, 8, 8), (10, 12, 9), (5, 6, 5), (1, 16, 3)], [0, 1, 3, 4], [(1, 1), (2, 1), (2, 3)])))
def test_unci_round_trip(depths, interleave, tiles):
    r = random.Random(str((depths, interleave, tiles)))
    planes = [[[r.randrange(1 << d) for _ in range(8)] for _ in range(6)] for d in depths]
    f = unci.decode(layout(depths, interleave, tiles=tiles), None, [4, 5, 6], None, w.pack_samples(planes, list(depths), interleave, tiles), 8, 6)
    for plane, got, d in zip(planes, (f.cr, f.y, f.cb), depths, strict=True):
        want = np.array(plane)
        want = want >> (d - 8) if d > 8 else (want * 255 + ((1 << d) - 1) // 2) // ((1 << d) - 1)
        assert (got == want).all()
    assert f.matrix == 0 and f.chroma == 3


def test_fixture_blocks():
    r, g, b = ([[x * a + y * c for x in range(4)] for y in range(4)] for a, c in ((40, 10), (20, 30), (15, 5)))
    data = b"".join((r[y][x] << 20 | g[y][x] << 10 | b[y][x]).to_bytes(4, "big") for y in range(4) for x in range(4))
    f = unci.decode(layout([10] * 3, 1, 4, 0, 4), None, [4, 5, 6], None, data, 4, 4)
    assert (fr.to_pixels(f) == np.stack([np.array(p) >> 2 for p in (r, g, b)], -1)).all()
    v = [[x * 50 + y * 80 for x in range(4)] for y in range(4)]
    f = unci.decode(layout([10], 0, 2, 0x60), None, [0], None, b"".join((v[y][x] << 6).to_bytes(2, "little") for y in range(4) for x in range(4)), 4, 4)
    assert (fr.to_pixels(f) == (np.array(v) >> 2)[..., None]).all()
    r, g, b = ([[x * 40 for x in range(4)] for _ in range(4)], [[y * 50] * 4 for y in range(4)], [[(x + y) * 30 for x in range(4)] for y in range(4)])
    data = b"".join((r[y][x] | g[y][x] << 8 | b[y][x] << 16).to_bytes(3, "little") for y in range(4) for x in range(4))
    f = unci.decode(layout([8] * 3, 1, 3, 0x60, 3), None, [4, 5, 6], None, data, 4, 4)
    assert (fr.to_pixels(f) == np.stack([np.array(p) for p in (r, g, b)], -1)).all()


def test_unci_rules():
    short = unci.decode(layout([8]), None, [0], None, b"\xff" * 5, 3, 3)
    assert short.y.ravel().tolist() == [255] * 5 + [0] * 4
    with pytest.raises(ValueError):
        unci.decode(layout([10], 0, 2, 0x60), None, [0], None, b"\xff" * 5, 3, 3)
    with pytest.raises(unci.Unsupported):
        unci.decode(layout([8]), {"type": "brot", "unit": 0}, [0], None, b"", 1, 1)
    raw = bytes(range(12))
    packed = [zlib.compress(raw[:6]), zlib.compress(raw[6:])]
    units = [{"offset": 0, "size": len(packed[0])}, {"offset": len(packed[0]), "size": len(packed[1])}]
    assert unci.unpacked("zlib", units, b"".join(packed)) == raw
    f = unci.decode(layout([8] * 3, 0, sampling=2), None, [1, 2, 3], None, bytes(range(24)), 4, 4)
    assert f.chroma == 1 and f.cb.tolist() == [[16, 17], [18, 19]] and f.cr.tolist() == [[20, 21], [22, 23]] and f.matrix == 6
    f = unci.decode(layout([8] * 3, 2, sampling=2), None, [1, 2, 3], None, bytes(range(24)), 4, 4)
    assert f.cb.tolist() == [[16, 18], [20, 22]] and f.cr.tolist() == [[17, 19], [21, 23]]
    f = unci.decode(layout([8, 8], 1, row_align=8, aligns=[0, 2]), None, [0, 7], None, bytes(range(18 * 2)), 2, 2)
    assert f.y.tolist() == [[0, 3], [8, 11]] and f.a.tolist() == [[2, 5], [10, 13]]


def ramp(width, height, chroma=3):
    f = fr.blank(width, height, 8, chroma, fill=(0, 128, 128))
    f.y[...] = np.arange(width * height).reshape(height, width)
    return f


def test_geometry():
    f = ramp(3, 2)
    assert fr.mirror(f, 1).y.tolist() == [[2, 1, 0], [5, 4, 3]] and fr.mirror(f, 0).y.tolist() == [[3, 4, 5], [0, 1, 2]]
    assert fr.rotate(f, 90).y.tolist() == [[3, 0], [4, 1], [5, 2]] and fr.rotate(f, 270).y.tolist() == [[2, 5], [1, 4], [0, 3]]
    cut = fr.aperture(ramp(5, 4), {"width_n": 2, "width_d": 1, "height_n": 9, "height_d": 1, "horiz_off_n": -1, "horiz_off_d": 2, "vert_off_n": 0, "vert_off_d": 1})
    assert cut.crop == (1, 2, 0, 0) and cut.width == 2 and cut.height == 4
    assert [fr.half_away(x) for x in (0.5, -0.5, 1.4, -1.6)] == [1, -1, 1, -2]
    turned = fr.rotate(cut, 90)
    assert (turned.width, turned.height) == (4, 2) and fr.to_pixels(turned)[..., 0].tolist() == np.rot90(fr.to_pixels(cut)[..., 0], -1).tolist()


def test_alpha_goes_along():
    f = fr.attach_alpha(ramp(4, 2), ramp(2, 2))
    assert f.a.tolist() == [[0, 0, 1, 1], [2, 2, 3, 3]]
    assert fr.mirror(f, 1).a.tolist() == [[1, 1, 0, 0], [3, 3, 2, 2]] and fr.rotate(f, 90).a.tolist() == [[2, 0], [2, 0], [3, 1], [3, 1]]
    assert fr.to_pixels(f, "bgra")[..., 3].tolist() == f.a.tolist()


def test_paste_cuts():
    out = fr.blank(4, 4, 8, 0, fill=(9, 0, 0))
    fr.paste(out, ramp(3, 3, 0), -1, 2)
    assert out.y.tolist() == [[9] * 4, [9] * 4, [1, 2, 9, 9], [4, 5, 9, 9]]
    fr.paste(out, ramp(3, 3, 0), 7, 0)
    assert out.y[0].tolist() == [9] * 4


def test_unset_samples_are_black_and_neutral():
    for chroma in (0, 1, 2, 3):
        assert not fr.to_pixels(fr.blank(3, 3, 8, chroma)).any()


def test_derived_layouts():
    assert grid_layout(bytes([0, 0, 1, 2]) + (30).to_bytes(2, "big") + (20).to_bytes(2, "big")) == (2, 3, 30, 20)
    body = bytes([0, 0]) + bytes(8) + (5).to_bytes(2, "big") + (6).to_bytes(2, "big") + b"\xff\xff\0\1"
    assert overlay_layout(body, 1) == (0, 5, 6, [(-1, 1)])
    with pytest.raises(ValueError):
        overlay_layout(body, 2)  # the second layer's place is missing


def test_colour_expressions_equal_the_kernel(spark):
    r = random.Random(5)
    rows = [(r.randrange(256), r.randrange(256), r.randrange(256), r.choice([0, 1, 2, 5, 6, 9]), r.random() < 0.5) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y int, cb int, cr int, m int, f boolean")
    from pyspark.sql import functions as F

    got = df.select("*", colour.to_rgb(F.col("y"), F.col("cb"), F.col("cr"), colour.used_matrix(F.col("m"), F.lit(3)), F.col("f")).alias("p")).collect()
    for x in got:
        f = fr.Frame(np.array([[x.y]], np.uint16), np.array([[x.cb]], np.uint16), np.array([[x.cr]], np.uint16), matrix=x.m, full_range=x.f)
        assert fr.to_pixels(f)[0, 0].tolist() == [x.p.r, x.p.g, x.p.b]


def test_pictures_report_what_they_cannot(spark):
    good = w.unci_file(bytes(range(12)), 2, 2, w.uncc([8] * 3, 1), (4, 5, 6))
    deep = w.still([{"id": i, "type": "iden"} for i in range(1, 7)] + [{"id": 7, "type": "unci", "props": [1, 2, 3], "parts": [bytes(4)]}], [w.ispe(2, 2), w.uncc([8]), w.cmpd(0)], [("dimg", i, [i + 1]) for i in range(1, 7)])
    other = w.still([{"id": 1, "type": "hvc1", "props": [1, 2]}], [w.ispe(2, 2), w.hvcc()])
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate((good, deep, other, b"x"))], "file_id int, content binary")
    got = {r.file_id: r for r in pictures(Container(rows)).collect()}
    assert bytes(got[0].data) == bytes(range(12)) and (got[0].width, got[0].stride) == (2, 6)
    assert [got[i].error for i in (1, 2, 3)] == ["derived images are nested too deep", "hevc pixels are unsupported", "the file is too short"]
    assert bytes(metrics.netpbm(pictures(Container(rows))).collect()[0].ppm) == b"P6\n2 2\n255\n" + bytes(range(12))


def test_streams_and_hashes(spark):
    assert metrics.split_annexb(b"\0\0\0\1\x40\1a\0\0\1\x42\1b\0") == [b"\x40\1a", b"\x42\1b"]
    assert metrics.length_prefixed(b"\0\0\0\2ab\0\0\0\x09c", 4) == [b"ab"]
    assert metrics.without_escapes(b"a\0\0\3\1\0\0\3") == b"a\0\0\1\0\0"
    rows = spark.createDataFrame([(1, [5, 6]), (2, [])], "id int, s array<int>")
    h = metrics.FNV_START
    for v in (5, 6):
        h = (h ^ v) * metrics.FNV_FACTOR % (1 << 64)
    assert {r.id: int(r.hash) for r in metrics.plane_hash(rows, "id", "s").collect()} == {1: h, 2: metrics.FNV_START}


def test_files_are_dealt_over_all_cores(spark):
    """A table of one split was one task, whatever its rows take."""
    from boxloom.queries import table, written

    made = written(table(spark, "/root/testdata/sf0.001", "part").select("p_partkey"), lambda key: b"%d" % key)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(len(p) > 0 for p in made.rdd.glom().collect())[-2:] == [True, True]
    assert {(r.file_id, bytes(r.content)) for r in made.collect()} == {(r.p_partkey, b"%d" % r.p_partkey) for r in table(spark, "/root/testdata/sf0.001", "part").collect()}


def test_plain_rows_are_those_of_arrow():
    from boxloom.operators.decode import plain

    kind = pa.struct([("n", pa.int64()), ("s", pa.struct([("a", pa.list_(pa.int32())), ("b", pa.binary())])), ("l", pa.list_(pa.struct([("x", pa.string()), ("none", pa.struct([("y", pa.int8())]))])))])
    rows = [None, {"n": 1, "s": None, "l": []}, {"n": None, "s": {"a": None, "b": b"q"}, "l": None}, {"n": 3, "s": {"a": [1, None], "b": None}, "l": [None, {"x": "u", "none": None}]}, {"n": 4, "s": {"a": [], "b": b""}, "l": [{"x": None, "none": None}]}]
    array = pa.array(rows * 3, kind)
    for part in (array, array.slice(2, 9), array.slice(1, 2), array.slice(3, 0), array.slice(5, 1)):
        assert plain(part) == part.to_pylist()


@pytest.mark.parametrize("depth", range(1, 17))
def test_bits_at_any_place(depth):
    data = bytes(random.Random(depth).randrange(256) for _ in range(9))
    text = "".join(format(b, "08b") for b in data) + "0" * 400
    at = np.array([[0, 8, 16, 64, 72, 80, 400], [1, 7, 13, 63, 66, 71, 300]])
    source = unci._Gather(data)
    for places in (at, at[:1]):
        want = [[int((text[p:] + "0" * 16)[:depth] or "0", 2) for p in row] for row in places.tolist()]
        assert source.bits(places, depth).tolist() == want


def test_places_of_a_layout_are_worked_out_once():
    data = bytes(range(48))
    unci._row.cache_clear()
    frames = [unci.decode(layout([8] * 3, 1), None, [4, 5, 6], None, data, 4, 4) for _ in range(5)]
    assert unci._row.cache_info().misses == 1 and unci._row.cache_info().hits == 4
    assert all((f.y == frames[0].y).all() for f in frames) and frames[0].y[0].tolist() == [1, 4, 7, 10]
