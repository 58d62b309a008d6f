"""Tracks of image sequences as expressions on the nested row of their file: samples, timelines and what makes them unsound.

The parser gives each run of a sample table what stands before it (samples, ticks, bytes), so a sample is found by binary search over
runs, and all samples of a track are unrolled run by run, in linear time. Nothing here joins, explodes or moves rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxloom.functions.arrays import below, let, number

#: How many samples and frames a track may have, and a duration without an end.
MOST_SAMPLES = 65_536
FOREVER = 0xFFFFFFFF
_DEC = "decimal(38,0)"
_div = lambda a, b: F.call_function("div", a, b)


def rescale(value: Column, source: Column, target: Column) -> Column:
    """floor(value * target / source) in two steps, null where the value is beyond 63 bits."""
    v = F.when(value <= (1 << 63) - 1, value.cast("bigint"))
    return (_div(v, source).cast("decimal(20,0)") * target.cast("decimal(12,0)") + _div((v % source).cast("decimal(12,0)") * target.cast("decimal(12,0)"), source.cast("decimal(12,0)")).cast("decimal(20,0)")).cast(_DEC)


def complete(t: Column) -> Column:
    return t["sizes"].isNotNull() & t["chunk_offsets"].isNotNull() & t["stsc"].isNotNull() & t["stts"].isNotNull()


def samples(t: Column) -> Column:
    """An array of (sample, offset, size, duration, decode_time, composition_time, is_sync, rank, gop) of a track, samples from 1 on; rank is
    the place in presentation order, gop the sample at which decoding must begin. Null where a table is missing."""
    n = F.size(t["sizes"]).cast("bigint")
    used = F.filter(t["stsc"], lambda r: (r["chunks"] > 0) & (r["per_chunk"] > 0) & (r["first_sample"] < n))
    of_run = lambda r, k: F.struct(F.get(t["chunk_offsets"], (r["first_chunk"] - 1 + k).cast("int")).alias("at"), (r["first_sample"] + k * r["per_chunk"]).alias("first"), r["per_chunk"].alias("per"))
    chunks = F.filter(F.flatten(F.transform(used, lambda r: F.transform(number(r["chunks"]), lambda k: of_run(r, k)))), lambda c: c["first"] < n)
    bytes_before = lambda s: F.get(t["size_sums"], s.cast("int"))
    in_chunk = lambda c: F.transform(F.sequence(c["first"], F.least(c["first"] + c["per"], n) - 1), lambda s: F.struct(s.alias("s"), (c["at"] + bytes_before(s) - bytes_before(c["first"])).cast("decimal(20,0)").alias("offset")))
    within = lambda runs: F.filter(runs, lambda r: r["first"] < n)
    rest = lambda r: F.least(r["count"], n - r["first"])
    times = F.flatten(F.transform(within(t["stts"]), lambda r: F.transform(number(rest(r)), lambda k: F.struct(r["delta"].alias("duration"), (r["time"] + k * r["delta"]).cast("bigint").alias("time")))))
    shifts = F.when(t["ctts"].isNotNull(), F.flatten(F.transform(within(t["ctts"]), lambda r: F.array_repeat(r["offset"], rest(r).cast("int")))))
    marks = F.filter(t["sync_sorted"], lambda s: s <= n)
    groups = F.flatten(F.transform(marks, lambda s, i: F.array_repeat(s, (F.coalesce(F.get(marks, i + 1), n + 1) - s).cast("int"))))
    parts = F.struct(F.flatten(F.transform(chunks, in_chunk)).alias("placed"), times.alias("times"), shifts.alias("shifts"), groups.alias("groups"), F.coalesce(F.get(marks, F.lit(0)) - 1, n).alias("lead"), (F.size(t["sync_sorted"]) == 0).alias("free"))

    def one(p: Column, x: Column) -> Column:
        s = x["s"].cast("int")
        at = F.get(p["times"], s)
        gop = F.when(p["free"], x["s"] + 1).when(x["s"] >= p["lead"], F.get(p["groups"], (x["s"] - p["lead"]).cast("int")))
        shown = at["time"] + F.coalesce(F.get(p["shifts"], s), F.lit(0))
        return F.struct((x["s"] + 1).alias("sample"), x["offset"].alias("offset"), F.get(t["sizes"], s).alias("size"), at["duration"].alias("duration"), at["time"].alias("decode_time"), shown.alias("composition_time"), F.coalesce(gop == x["s"] + 1, F.lit(False)).alias("is_sync"), gop.alias("gop"))

    def ranked(rows: Column) -> Column:
        order = F.array_sort(F.transform(rows, lambda x, i: F.struct(x["composition_time"].alias("at"), x["sample"].alias("sample"), i.alias("i"))))
        back = F.array_sort(F.transform(order, lambda x, rank: F.struct(x["i"].alias("i"), rank.alias("rank"))))
        return let(back, lambda b: F.transform(rows, lambda x, i: x.withField("rank", F.get(b, i)["rank"])))

    each = let(parts, lambda p: F.filter(F.transform(p["placed"], lambda x: one(p, x)), lambda x: x["duration"].isNotNull()))
    return F.when(complete(t), let(each, ranked))


def sample_at(t: Column, sample: Column) -> Column:
    """(sample, offset, size, duration, decode_time, composition_time) of one sample, found by binary search over the runs; null where the
    track has no such sample."""
    s = sample.cast("bigint") - 1
    run = F.get(t["stsc"], below(t["stsc"], s + 1, lambda r: r["first_sample"]) - 1)
    timed, late = (F.get(t[k], below(t[k], s + 1, lambda r: r["first"]) - 1) for k in ("stts", "ctts"))

    def of(x: Column) -> Column:
        r, d, c = x["run"], x["timed"], x["late"]
        chunk = _div(s - r["first_sample"], r["per_chunk"])
        first = r["first_sample"] + chunk * r["per_chunk"]
        bytes_before = lambda i: F.get(t["size_sums"], i.cast("int"))
        offset = (F.get(t["chunk_offsets"], (r["first_chunk"] - 1 + chunk).cast("int")) + bytes_before(s) - bytes_before(first)).cast("decimal(20,0)")
        time = (d["time"] + (s - d["first"]) * d["delta"]).cast("bigint")
        shift = F.when(s < c["first"] + c["count"], c["offset"])
        found = (chunk < r["chunks"]) & (s < d["first"] + d["count"])
        return F.when(found, F.struct((s + 1).alias("sample"), offset.alias("offset"), F.get(t["sizes"], s.cast("int")).alias("size"), d["delta"].alias("duration"), time.alias("decode_time"), (time + F.coalesce(shift, F.lit(0))).alias("composition_time")))

    inside = complete(t) & (s >= 0) & (s < F.size(t["sizes"]))
    runs = F.struct(run.alias("run"), timed.alias("timed"), late.alias("late"))
    return F.when(inside, let(runs, lambda x: F.when(x["run"]["per_chunk"] > 0, of(x))))


def first_sample(t: Column, file_len: Column) -> Column:
    """The sample that stands for a track, its first sync sample or its first; null where it is empty or leaves the file."""
    got = sample_at(t, F.coalesce(F.get(t["sync"], F.lit(0)), F.lit(1)))
    return let(got, lambda x: F.when((x["size"] > 0) & (x["offset"] + x["size"] <= file_len), x))


def error_of(t: Column, rows: Column, file_len: Column) -> Column:
    """What makes a track with these samples unsound; null where nothing does."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    rising = lambda a: F.forall(F.transform(a, lambda x, i: F.when(i == 0, x >= 1).otherwise(x > F.element_at(a, i))), lambda ok: ok)
    count = F.size(t["sizes"])
    rules = (
        ("sample tables are missing", ~complete(t)),
        ("no timescale", t["timescale"].isNull()),
        ("stsc does not begin with the first chunk, or isn't in order", (F.get(t["stsc"], F.lit(0))["first_chunk"] != 1) | ~rising(F.transform(t["stsc"], lambda x: x["first_chunk"]))),
        ("stts or ctts doesn't cover the samples", (total(t["stts"]) != count) | (t["ctts"].isNotNull() & (total(t["ctts"]) != count))),
        ("stss isn't in order", t["sync"].isNotNull() & (~rising(t["sync"]) | F.exists(t["sync"], lambda x: x > count))),
        ("chunks don't hold all samples", F.coalesce(F.size(rows), F.lit(0)) != count),
        ("a sample is empty or leaves the file", F.exists(rows, lambda x: (x["size"] < 1) | (x["offset"] + x["size"] > file_len))),
        ("an edit has another rate than 1", t["edits"].isNotNull() & F.exists(t["edits"], lambda e: (e["rate"] != 1) | (e["rate_fraction"] != 0))),
        ("too many frames", t["edits"].isNotNull() & (count.cast("bigint") * F.size(t["edits"]) > MOST_SAMPLES)),
    )
    out = F.lit(None).cast("string")
    for text, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), text).otherwise(out)
    return out


def frames(t: Column, rows: Column, movie_scale: Column) -> Column:
    """An array of (sample, time, duration): what is shown, in order, in ticks of the movie. Samples of an edit are a stretch of the samples
    in presentation order, whose ends binary search finds; so the work is that of what is shown."""
    media, movie = t["timescale"], F.coalesce(movie_scale, t["timescale"])
    shown = F.array_sort(F.transform(rows, lambda s: F.struct(s["rank"].alias("rank"), s["composition_time"].alias("at"), s["duration"].alias("duration"), s["sample"].alias("sample"))))
    frame = lambda s, time: F.struct(s["sample"].alias("sample"), time.cast("decimal(20,0)").alias("time"), rescale(s["duration"], media, movie).cast("bigint").alias("duration"))
    plain = lambda a: F.transform(a, lambda s: frame(s, rescale(s["at"] - F.get(a, F.lit(0))["at"], media, movie)))

    def edited(a: Column, e: Column) -> Column:
        ends = F.struct(below(a, e["media_time"], lambda s: s["at"]).alias("lo"), below(a, e["media_time"] + rescale(e["segment"], movie, media), lambda s: s["at"]).alias("hi"))
        cut = lambda x: F.slice(a, x["lo"] + 1, F.greatest(x["hi"] - x["lo"], F.lit(0)))
        time = lambda s: (e["before"] + rescale(s["at"] - e["media_time"], media, movie)).cast(_DEC)
        return let(ends, lambda x: F.transform(cut(x), lambda s: frame(s, time(s))))

    cuts = lambda a: F.flatten(F.transform(F.filter(t["edits"], lambda e: (e["media_time"] >= 0) & rescale(e["segment"], movie, media).isNotNull()), lambda e: edited(a, e)))
    return let(shown, lambda a: F.when(t["edits"].isNull(), plain(a)).otherwise(cuts(a)))


def duration_of(t: Column, movie_scale: Column, movie_duration: Column) -> Column:
    scale = F.coalesce(movie_scale, t["timescale"])
    return F.when(F.coalesce(movie_duration, F.lit(0)) > 0, movie_duration.cast(_DEC)).otherwise(rescale(t["media_duration"], t["timescale"], scale))


def repetitions(t: Column, length: Column) -> Column:
    edit = F.get(t["edits"], F.lit(0))
    segment = edit["segment"].cast(_DEC)
    loops = t["edit_repeat"] & (F.size(t["edits"]) == 1) & (edit["media_time"] == 0)
    all_ones = length.isin(F.lit(FOREVER).cast(_DEC), F.lit(str((1 << 64) - 1)).cast(_DEC))
    parts = F.when(segment > 0, F.when(length % segment == 0, (length / segment).cast("bigint")))
    return F.when(t["edits"].isNull(), 1).when(loops & all_ones, FOREVER).when(loops & (parts <= FOREVER), parts).otherwise(0).cast("bigint")


def coded(t: Column) -> Column:
    return t["hvcc"].isNotNull() | t["av1c"].isNotNull()


def role_numbers(tracks: Column, lim) -> Column:
    """(image, alpha, thumbnail, alphas) of a file's tracks: their numbers, null where there is none, and how many alpha tracks there are."""
    fits = lambda m: (m["width"] > 0) & (m["height"] > 0) & (m["width"] <= lim.width) & (m["height"] <= lim.height) & (m["width"] * m["height"] <= lim.pixels)
    main = F.array_min(F.transform(F.filter(tracks, lambda t: coded(t) & t["handler"].isin("pict", "vide")), lambda t: F.struct((t["handler"] != "pict").alias("other"), *[t[k].alias(k) for k in ("track", "track_id", "width", "height")])))

    def of(m: Column) -> Column:
        others = lambda p: F.transform(F.filter(tracks, lambda t: coded(t) & (t["track"] != m["track"]) & F.coalesce(p(t), F.lit(False))), lambda t: t["track"])
        alphas = others(lambda t: (t["handler"] == "auxv") & t["is_alpha"] & (t["aux_for"] == m["track_id"]))
        small = others(lambda t: (t["handler"] == "pict") & ~((t["width"] >= m["width"]) & (t["height"] >= m["height"])) & t["shown"].isNotNull())
        return F.struct(m["track"].alias("image"), F.when(F.size(alphas) == 1, F.get(alphas, F.lit(0))).alias("alpha"), F.get(small, F.lit(0)).alias("thumbnail"), F.size(alphas).alias("alphas"))

    return let(main, lambda m: F.when(fits(m), of(m)))


def same_times(a: Column, b: Column) -> Column:
    """Whether two tracks show as many frames at the same times, and repeat alike; null where one shows none."""
    some = (F.size(a["frames"]) > 0) & (F.size(b["frames"]) > 0)
    alike = F.forall(F.zip_with(a["frames"], b["frames"], lambda x, y: x["time"].eqNullSafe(y["time"]) & x["duration"].eqNullSafe(y["duration"])), lambda ok: ok)
    return F.when(some, (F.size(a["frames"]) == F.size(b["frames"])) & (a["repetitions"] == b["repetitions"]) & alike)
