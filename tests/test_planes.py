"""Planes at native depth, strides, means, pairs of pictures, and work that is given up."""

import hashlib
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.operators import metrics
from boxloom.operators.decode import at_stride, needed_bytes, pictures, planes, raw
from boxloom.plans.probe import GaveUp, within
from boxloom.sources import writer as w
from boxloom.sources.tables import Container


def files(spark, *contents):
    return Container(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary"))


def picture(depth, size=4, steps=(), seed=0):
    values = [[[(seed + c * 300 + x * 97 + y * 31) % (1 << depth) for x in range(size)] for y in range(size)] for c in range(3)]
    return values, w.unci_file(w.pack_samples(values, [depth] * 3, 0), size, size, w.uncc([depth] * 3), (1, 2, 3), steps)


@pytest.mark.parametrize("depth", [5, 8, 9, 10, 12, 16])
def test_planes_keep_their_depth(spark, depth):
    values, data = picture(depth)
    (row,) = planes(files(spark, data)).collect()
    assert row.error is None and [(p.name, p.width, p.height, p.depth) for p in row.planes] == [(n, 4, 4, depth) for n in ("y", "cb", "cr")]
    kind = "<u2" if depth > 8 else "u1"
    assert [np.frombuffer(bytes(p.data), kind).reshape(4, 4).tolist() for p in row.planes] == values
    (file,) = raw(planes(files(spark, data))).collect()
    assert bytes(file.raw) == b"".join(np.array(v, kind).tobytes() for v in values)


def test_planes_are_cut_and_turned(spark):
    values, data = picture(10, 5, [w.clap(3, 3), w.irot(1)])
    (row,) = planes(files(spark, data)).collect()
    want = np.rot90(np.array(values[0])[1:4, 1:4], 1)
    assert np.frombuffer(bytes(row.planes[0].data), "<u2").reshape(3, 3).tolist() == want.tolist()


def test_planes_of_half_size_and_none(spark):
    luma, chroma = bytes(range(16)), bytes(range(100, 108))
    small = w.unci_file(luma + chroma, 4, 4, w.uncc([8] * 3, 0, sampling=2), (1, 2, 3), [w.clap(2, 2)])
    grey = w.unci_file(luma, 4, 4, w.uncc([8]), (0,))
    mixed = w.unci_file(luma * 4, 4, 4, w.uncc([8, 10, 8]), (1, 2, 3))
    rows = {r.file_id: r for r in planes(files(spark, small, grey, mixed, b"junk")).collect()}
    assert [(p.name, p.width, p.height, bytes(p.data)) for p in rows[0].planes] == [("y", 2, 2, bytes([5, 6, 9, 10])), ("cb", 1, 1, b"d"), ("cr", 1, 1, b"h")]
    assert rows[2].error == "components of several depths have no planes of one" and rows[3].error and rows[1].planes[0].depth == 8


def test_plane_differences(spark):
    a, b = (planes(files(spark, *(picture(10, seed=s)[1] for s in seeds))) for seeds in ((0, 5, 9), (0, 6, 9)))
    got = {(r.file_id, r.plane): r for r in metrics.plane_differences(a.where("file_id < 2"), b.where("file_id > 0"), ["file_id"]).collect()}
    assert all(r.n is None and r.sse is None and not r.md5_equal for k, r in got.items() if k[0] != 1)
    left, right = (np.array(picture(10, seed=s)[0][0]).astype(int) for s in (5, 6))
    d = np.abs(left - right)
    assert (got[1, "y"].n, got[1, "y"].sse, got[1, "y"].max_diff, got[1, "y"].depth) == (16, (d * d).sum(), d.max(), 10)
    assert {r.md5_equal for r in metrics.plane_differences(a, a, ["file_id"]).collect()} == {True}


def test_strides(spark):
    data = w.unci_file(bytes(range(18)), 3, 2, w.uncc([8] * 3, 1), (4, 5, 6))
    p = pictures(files(spark, data, b"junk"))
    plain = bytes(next(r for r in p.collect() if r.file_id == 0).data)
    for stride in (9, 12):
        rows = {r.file_id: r for r in at_stride(p, F.lit(stride)).collect()}
        assert bytes(rows[0].data) == plain[:9] + bytes(stride - 9) + plain[9:] and rows[0].stride == stride and rows[1].data is None and rows[1].error
    assert [r.error for r in at_stride(p.where("file_id = 0"), F.lit(8)).collect()] == ["the stride is too small"]
    assert spark.range(1).select(needed_bytes(F.lit(3), F.lit(2), F.lit("rgba"), F.lit(20)).alias("n")).first().n == 32


def test_means_equal_those_of_rows_of_bytes(spark):
    r = random.Random(4)
    data = []
    for width, height in ((16, 16), (20, 33), (47, 18)):
        values = [[[r.randrange(256) for _ in range(width)] for _ in range(height)] for _ in range(3)]
        data.append(w.unci_file(w.pack_samples(values, [8] * 3, 1), width, height, w.uncc([8] * 3, 1), (4, 5, 6)))
    small = w.unci_file(bytes(15 * 16), 15, 16, w.uncc([8]), (0,))
    p = pictures(files(spark, *data, small, b"junk"))
    from boxloom.operators.decode import pixels

    rows = {x.file_id: x.means for x in metrics.thumbs(p).collect()}
    assert rows[3] is None and rows[4] is None
    for x in metrics.box_means(pixels(p.where("file_id < 3")), ["file_id"]).collect():
        assert rows[x.file_id][(x.cy * 16 + x.cx) * 3 + x.ch] == x.v


def test_pairs_are_met_once(spark):
    p = pictures(files(spark, *(w.unci_file(bytes([v] * 16), 4, 4, w.uncc([8]), (0,)) for v in (1, 4, 4)), w.unci_file(bytes(25), 5, 5, w.uncc([8]), (0,)), b"junk"))
    of = F.array(*[F.struct((F.col("file_id") - n).alias("pair"), F.lit(n).alias("side")) for n in (0, 1)])
    got = {r.pair: (r.n, r.sse, r.max_diff, r.n_diff) for r in metrics.differences(metrics.paired(p, of, ["width", "height", "format", "data"])).collect()}
    assert got == {0: (48, 48 * 9, 3, 48), 1: (48, 0, 0, 0), 2: (None,) * 4}


def test_seeded_pick(spark):
    names = spark.range(200).select(F.concat(F.lit("f"), "id").alias("name"))
    one, again, other = (sorted(r.name for r in metrics.pick(df, "name", 20, seed).collect()) for df, seed in ((names, 1), (names.repartition(5), 1), (names, 2)))
    assert one == again != other and len(one) == 20 and len(set(one)) == 20
    assert metrics.pick(names.limit(0), "name", 5).count() == 0 and metrics.pick(names, "name", 500).count() == 200


def test_work_is_given_up_and_done_again(spark):
    def slow(seconds):
        def run(batches):
            for b in batches:
                time.sleep(seconds)
                yield b

        return lambda: spark.range(4, numPartitions=4).mapInArrow(run, "id long").agg(F.sum("id")).first()[0]

    start = time.time()
    with pytest.raises(GaveUp):
        within(spark, slow(60), seconds=2)
    assert time.time() - start < 40
    assert within(spark, slow(0), seconds=60) == 6  # the same work, to its end
    stop = threading.Event()
    threading.Timer(1, stop.set).start()
    with pytest.raises(GaveUp):
        within(spark, slow(60), stop=stop)
    with pytest.raises(ZeroDivisionError):
        within(spark, lambda: 1 // 0)
    assert spark.range(5).count() == 5 and not spark.sparkContext.getJobTags()


def test_digests_come_with_the_differences(spark):
    """A join with digests from elsewhere decoded one side again and sent a row for each plane to the driver."""
    from boxloom import queries

    a, b = (planes(files(spark, *(picture(10, seed=s)[1] for s in seeds))) for seeds in ((0, 5), (0, 6, 9)))
    got = {(r.file_id, r.plane): r for r in metrics.plane_differences(a, b, ["file_id"], digests=True).collect()}
    want = {(r.file_id, p.name): hashlib.md5(bytes(p.data)).hexdigest() for r in a.collect() for p in r.planes}
    assert {k: r.md5 for k, r in got.items()} == want | {(2, n): None for n in ("y", "cb", "cr")}
    assert (got[0, "y"].md5_equal, got[1, "y"].md5_equal, got[2, "y"].n) == (True, False, None)
    plan = queries.native_planes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
