"""Sample tables and timelines, against summaries of published sequences."""

import pytest

from pyspark.sql import functions as F

from boxloom.operators.decode import pictures
from boxloom.plans.items import info, item_payloads, references, resolved_items
from boxloom.plans.sequences import Sequences, lookup
from boxloom.sources import writer as w
from boxloom.sources.tables import Container


def sequences(spark, *contents):
    return Sequences(Container(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")))


def even(n, delta, **how):
    return w.track([4] * n, [(n, delta)], [32], [(1, n)], **how)


def movie(track, duration, timescale=1000, wide=False):
    return w.movie([track], timescale, duration, bytes(400), wide)


#: frames, timescale, duration, repetitions, first and last time of some sequences.
PUBLISHED = [
    (movie(even(8, 20), 160), (8, 1000, 160, 1, 0, 140)),
    (movie(even(16, 20), 320), (16, 1000, 320, 1, 0, 300)),
    (movie(even(13, 100, edits=[(1300, 0)]), 100500), (13, 1000, 100500, 0, 0, 1200)),
    (movie(even(8, 100, edits=[(500, -1), (800, 0)]), 100500), (8, 1000, 100500, 0, 500, 1200)),
    (movie(even(8, 100), 800), (8, 1000, 800, 1, 0, 700)),
    (movie(even(8, 100, edits=[(800, 0)], loop=True), 2400), (8, 1000, 2400, 3, 0, 700)),
    (movie(even(8, 100, edits=[(800, 0)], loop=True), 1201), (8, 1000, 1201, 0, 0, 700)),
    (movie(even(8, 100, edits=[(800, 0)], loop=True), 4294967295), (8, 1000, 4294967295, 4294967295, 0, 700)),
    (movie(even(8, 100, edits=[(800, 0)]), 2000), (8, 1000, 2000, 0, 0, 700)),
    (movie(even(5, 1, timescale=30, edits=[(5, 0)]), 5, 30), (5, 30, 5, 0, 0, 4)),
    (movie(even(5, 5, timescale=30, edits=[(25, 0)], loop=True), (1 << 64) - 1, 30, wide=True), (5, 30, (1 << 64) - 1, 4294967295, 0, 20)),
]


def test_published_summaries(spark):
    s = sequences(spark, *(p[0] for p in PUBLISHED))
    rows = {r.file_id: (r.frames, r.timescale, int(r.duration), r.repetitions, int(r.first_time), int(r.last_time)) for r in s.info.collect()}
    assert rows == {i: p[1] for i, p in enumerate(PUBLISHED)}


def test_order_of_presentation_and_groups(spark):
    s = sequences(spark, movie(w.track([5, 6, 7, 8], [(4, 10)], [32, 60], [(1, 3), (2, 1)], shifts=[(1, 0), (1, 20), (2, -10)], sync=[1, 4]), 40))
    rows = s.samples.orderBy("sample").collect()
    assert [(int(r.offset), r.size, r.composition_time, r["rank"], r.is_sync, r.gop) for r in rows] == [(32, 5, 0, 0, True, 1), (37, 6, 30, 3, False, 1), (43, 7, 10, 1, False, 1), (60, 8, 20, 2, True, 4)]
    assert [r.sample for r in s.frames.orderBy("frame").collect()] == [1, 3, 4, 2]


@pytest.mark.parametrize(
    ("track", "error"),
    [
        (w.track([4] * 3, [(2, 10)], [32], [(1, 3)]), "stts or ctts doesn't cover the samples"),
        (w.track([4] * 3, [(3, 10)], [32], [(1, 2)]), "chunks don't hold all samples"),
        (w.track([4] * 3, [(3, 10)], [32], [(2, 3)]), "stsc does not begin with the first chunk, or isn't in order"),
        (w.track([4, 4000], [(2, 10)], [32], [(1, 2)]), "a sample is empty or leaves the file"),
        (w.track([4] * 3, [(3, 10)], [32], [(1, 3)], sync=[2, 1]), "stss isn't in order"),
    ],
)
def test_broken_tracks_have_errors_and_no_frames(spark, track, error):
    s = sequences(spark, movie(track, 30))
    assert [r.error for r in s.errors.collect()] == [error]
    assert s.frames.count() == 0


def test_roles_and_alpha(spark):
    pict = even(4, 10, track_id=1)
    alpha = even(4, 10, track_id=2, handler="auxv", alpha_of=1)
    odd = w.track([4] * 4, [(3, 10), (1, 20)], [32], [(1, 4)], track_id=2, handler="auxv", alpha_of=1)
    small = even(4, 10, track_id=3, width=8, height=8)
    s = sequences(spark, w.movie([pict, alpha, small], 1000, 40, bytes(400)), w.movie([pict, odd], 1000, 40, bytes(400)))
    assert {(r.file_id, r.track, r.role) for r in s.roles.collect()} == {(0, 0, "image"), (0, 1, "alpha"), (0, 2, "thumbnail"), (1, 0, "image"), (1, 1, "alpha")}
    assert {r.file_id: r.matches for r in s.alpha_matches.collect()} == {0: True, 1: False}


def test_movies_are_sequences_where_they_can_be_shown(spark):
    pair = lambda delta, at=32: w.movie([even(4, 20, width=70, height=50), w.track([4] * 4, [(4, delta)], [at], [(1, 4)], track_id=2, handler="auxv", alpha_of=1)], 1000, 80, bytes(400), brands=("avis", "mif1"))
    still = w.still([{"id": 1, "type": "hvc1", "props": [1, 2]}], [w.ispe(5, 6), w.hvcc()])
    files = [pair(20), pair(30), pair(20, 9999), movie(even(2, 5), 10), still, b"junk"]
    s = sequences(spark, *files)
    rows = {r.file_id: (r.kind, r.width, r.height, r.has_alpha, r.error) for r in info(s.c).collect()}
    assert rows[0] == ("sequence", 70, 50, True, None)
    assert rows[1] == rows[2] == ("avif", None, None, None, "no primary item")
    assert rows[3] == ("sequence", 64, 64, False, None) and rows[4] == ("heic", 5, 6, False, None) and rows[5][0] is None and rows[5][4]
    assert {r.file_id: r.matches for r in s.alpha_matches.collect()} == {0: True, 1: False}


def test_movies_are_items(spark):
    """Movies alone, beside still images, and unsound ones."""
    tracks = [even(4, 20, width=70, height=50), w.track([4] * 4, [(4, 20)], [36], [(1, 4)], sync=[3], track_id=2, handler="auxv", alpha_of=1), w.track([6, 7], [(2, 40)], [60], [(1, 2)], track_id=3, width=7, height=5)]
    still = w.still([{"id": 0xFFFF, "type": "hvc1", "props": [1, 2]}], [w.ispe(5, 6), w.hvcc()], brands=("mif1", "msf1"), primary=0xFFFF)
    both = still + w.movie(tracks[:1], 1000, 80)[-len(w.movie(tracks[:1], 1000, 80)) + 24 + 8 :]
    files = [w.movie(tracks, 1000, 80, bytes(400)), w.movie(tracks[:2] + tracks[1:2], 1000, 80, bytes(400)), both]
    c = Container(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "file_id long, content binary"))
    rows = {(r.file_id, r.item_id): r for r in resolved_items(c).collect()}
    assert set(rows) == {(0, 1), (0, 2), (0, 3), (2, 0xFFFF), (2, 0xFFFFFFFF)}
    assert (rows[0, 1].ispe.width, rows[0, 1].hvcc.bit_depth, rows[0, 3].ispe.height, rows[2, 0xFFFFFFFF].ispe.width) == (70, 8, 5, 70)
    assert [(r.file_id, r.from_id, r.to_id) for r in references(c, "thmb").collect()] == [(0, 3, 1)]
    assert sorted((r.file_id, r.item_id, len(r.payload)) for r in item_payloads(c).where("item_id < 65535").collect()) == [(0, 1, 4), (0, 2, 4), (0, 3, 6)]
    assert sorted((r.item_id, int(r.offset), int(r.length)) for r in c.extents.where("file_id = 0").collect()) == [(1, 32, 4), (2, 44, 4), (3, 60, 6)]
    assert {r.file_id: (r.kind, r.width, r.has_alpha, r.has_thumbnail, r.error) for r in info(c).collect()} == {0: ("sequence", 70, True, True, None), 1: ("heic", None, None, None, "no primary item"), 2: ("sequence", 5, False, False, None)}
    assert {r.file_id: r.error for r in pictures(c).collect()} == {0: "hevc pixels are unsupported", 1: "item None is missing", 2: "hevc pixels are unsupported"}


def test_samples_are_found_without_unrolling(spark):
    import random

    r = random.Random(3)
    files = []
    for _ in range(20):
        n = r.randint(1, 60)
        sizes, cuts = [r.randint(1, 9) for _ in range(n)], sorted(r.sample(range(1, n), min(n - 1, r.randint(0, 5)))) if n > 1 else []
        counts = [b - a for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        chunks = [(i + 1, k) for i, k in enumerate(counts)]
        runs = lambda low, high: [(k, r.randint(low, high)) for k in counts]
        files.append(w.movie([w.track(sizes, runs(1, 9), [32 + 100 * i for i in range(len(counts))], chunks, runs(-5, 5) if r.random() < 0.6 else None)], 1000, 100, bytes(4000)))
    s = sequences(spark, *files)
    columns = ["file_id", "sample", "offset", "size", "duration", "decode_time", "composition_time"]
    every = sorted(s.samples.select(*columns).collect())
    found = lookup(s.c, F.sequence(F.lit(0), F.lit(70)))
    assert sorted(found.where("offset is not null").withColumnRenamed("wanted", "sample").select(*columns).collect()) == every
    assert found.where("offset is null").count() == 71 * 20 - len(every)
    plan = lookup(s.c, F.array(F.lit(5)))._jdf.queryExecution().executedPlan().toString()
    assert not {"Window", "Exchange", "Join"} & set(plan.replace("(", " ").split())


def test_many_edits_take_the_work_of_what_is_shown(spark):
    edits = [(2, (i * 7) % 60) for i in range(1000)]
    s = sequences(spark, movie(w.track([4] * 65, [(65, 1)], [32], [(1, 65)], edits=edits), 2000))
    rows = s.frames.orderBy("frame").collect()
    assert len(rows) == 2000 and [(r.sample, int(r.time)) for r in rows[:4]] == [(1, 0), (2, 1), (8, 2), (9, 3)]
    assert s.info.first().frames == 2000
    assert not spark.sparkContext._jsc.getPersistentRDDs()
