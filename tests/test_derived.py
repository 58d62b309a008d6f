"""Decoding order, regions of grids, memory limits and the table function."""

import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from boxloom.operators import unci
from boxloom.operators.decode import pictures
from boxloom.plans import derived
from boxloom.plans import items as it
from boxloom.sources import writer as w
from boxloom.sources.boxes import box_tree
from boxloom.sources.container import Limits
from boxloom.sources.tables import Container, box_rows, register_functions


def files(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")


def test_levels_against_search():
    r = random.Random(8)
    for _ in range(300):
        items = list(range(r.randint(1, 9)))
        needs = {i: [r.choice([*items, 99]) if r.random() < 0.1 else r.choice(items) for _ in range(r.randint(0, 2))] for i in items if r.random() < 0.6}

        def height(i, above=()):
            if i in above or i not in items:  # noqa: B023
                return None
            below = [height(n, (*above, i)) for n in needs.get(i, ())]  # noqa: B023
            return None if None in below else 1 + max(below, default=-1)

        got = derived.levels_of(items, needs)
        assert {i: got[i][0] for i in items} == {i: height(i) for i in items}
        assert all((e is None) == (level is not None and level <= derived.DEPTH) for level, e in got.values())


def test_levels_of_long_chains_and_wide_files():
    n = 60_000
    got = derived.levels_of(list(range(n)), {i: [i - 1] for i in range(1, n)})
    assert got[n - 1] == (n - 1, "nested too deep") and got[4] == (4, None)
    got = derived.levels_of(list(range(n)), {i: [(i + 1) % n] for i in range(n)})
    assert set(got.values()) == {(None, "in a cycle, or over one")}
    assert derived.levels_of(list(range(n)), {0: list(range(1, n))})[0] == (1, None)


def grid(rows, cols, tw, th, width, height, wide=False):
    size = 4 if wide else 2
    body = bytes([0, int(wide), rows - 1, cols - 1]) + width.to_bytes(size, "big") + height.to_bytes(size, "big")
    tiles = [{"id": i + 2, "type": "hvc1", "props": [1, 2], "parts": [bytes([i])]} for i in range(rows * cols)]
    return w.still([{"id": 1, "type": "grid", "parts": [body]}, *tiles], [w.ispe(tw, th), w.hvcc()], [("dimg", 1, [t["id"] for t in tiles])])


@pytest.mark.parametrize("region", [(0, 0, 100, 100), (5, 3, 6, 4), (-4, -4, 9, 9), (8, 0, 8, 9), (50, 50, 60, 60), (7, 3, 17, 9)])
def test_regions_are_put_together_from_tiles(spark, region):
    layouts = [(2, 3, 8, 4, 22, 7), (1, 1, 5, 5, 5, 5), (3, 2, 8, 4, 16, 12), (1, 2, 4, 9, 20, 20)]
    c = Container(files(spark, *(grid(*x, wide=i % 2 == 1) for i, x in enumerate(layouts))))
    got = derived.region_tiles(c, *map(F.lit, region), payloads=True).collect()
    for i, (rows, cols, tw, th, width, height) in enumerate(layouts):
        seen = {}
        for r in (r for r in got if r.file_id == i):
            assert r.error is None and bytes(r.payload) == bytes([r.no]) and r.tile_id == r.no + 2 and r.width > 0 < r.height
            for y in range(r.height):
                for x in range(r.width):
                    at = (r.target_x + x, r.target_y + y)
                    assert at not in seen
                    seen[at] = (r.no % cols * tw + r.source_x + x, r.no // cols * th + r.source_y + y)
                    assert r.source_x + x < tw and r.source_y + y < th
        x0, y0 = max(region[0], 0), max(region[1], 0)
        x1, y1 = min(region[2], width, cols * tw), min(region[3], height, rows * th)
        assert seen == {(x - x0, y - y0): (x, y) for x in range(x0, x1) for y in range(y0, y1)}


def test_grids_that_cant_be_laid_out(spark):
    broken = [grid(2, 2, 4, 4, 8, 8).replace(b"ispe", b"free"), w.still([{"id": 1, "type": "grid", "parts": [b"\0\0\1"]}], []), w.still([{"id": 1, "type": "grid"}], []), grid(1, 1, 4, 4, 20_000, 4), grid(1, 1, 4, 4, 0, 4)]
    got = {r.file_id: (r.error, r.no) for r in derived.region_tiles(Container(files(spark, *broken)), *map(F.lit, (0, 0, 9, 9))).collect()}
    assert got == {0: ("the grid's first tile has no size", None), 1: ("the grid's layout ends early", None), 2: ("no extents", None), 3: ("the grid is too large", None), 4: ("the grid is too large", None)}
    assert derived.order(Container(files(spark, b"junk"))).count() == 0


def test_a_packed_bomb_is_not_inflated(spark):
    bomb = zlib.compress(bytes(200_000_000))
    tracemalloc.start()
    assert len(unci.unpacked("zlib", None, bomb, 1000)) == 1000
    units = [{"offset": 0, "size": len(bomb)}] * 50
    assert len(unci.unpacked("zlib", units, bomb, 1000)) == 1000
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    form = w.uncc([8])
    c = Container(files(spark, w.unci_file(bomb, 4, 4, form, (0,), [w.cmpc("zlib")])))
    assert [(r.width, r.error, len(r.data)) for r in pictures(c).collect()] == [(4, None, 48)]
    aligned = w.unci_file(bomb, 4, 4, w.uncc([8], row_align=1 << 30), (0,), [w.cmpc("zlib")])
    assert [r.error for r in pictures(Container(files(spark, aligned))).collect()] == ["the image needs more memory than allowed"]


def test_memory_limit(spark):
    plain = w.unci_file(bytes(100), 10, 10, w.uncc([8]), (0,))
    for memory, error in ((4_900, None), (4_899, "the file needs more memory than allowed")):
        assert [r.error for r in pictures(Container(files(spark, plain), Limits(memory=memory))).collect()] == [error]
    tight = Container(files(spark, plain), Limits(width=9))
    assert [r.within_limits for r in it.info(tight).collect()] == [False] and [r.error for r in pictures(tight).collect()] == ["the image is too large"]


def test_boxes_of_any_depth(spark):
    data = b""
    for _ in range(30):
        data = w.box("moov", data)
    assert [r[2] for r in box_tree(data)] == list(range(30)) and box_tree(data)[7][:2] == (7, 6)
    register_functions(spark)
    f = files(spark, data, b"junk", w.still([{"id": 1, "type": "hvc1"}], []))
    sql = spark.sql("SELECT f.file_id, b.* FROM {f} f, LATERAL box_scan(f.content) b", f=f)
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, box_rows(f).select(*sql.columns).collect()))
    deep = b""
    for _ in range(3000):
        deep = w.box("moov", deep)
    assert len(box_tree(deep)) == 3000
