"""Movies as items: the tracks of a movie that can be shown become items in the row of their file, before any question about items.

The image track is an item with its size, its codec and its colour, whose payload is the track's first sync sample; its alpha and its
thumbnail track are items likewise, the thumbnail with a reference to the image. In a file without still images they have the numbers 1, 2
and 3, and the image is the primary item; beside still images they have the highest free numbers. All is done by expressions on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions import tracks as tr
from boxloom.functions.arrays import let
from boxloom.sources.schema import NESTED, ROWS

HIGHEST = 0xFFFFFFFF


def told(tracks: Column, file_len: Column, movie_scale: Column, movie_duration: Column) -> Column:
    """The tracks with their samples, error, the sample that stands for them, repetitions, and their frames where they are sound."""
    first = F.transform(tracks, lambda t: let(tr.samples(t), lambda s: t.withField("samples", s).withField("error", tr.error_of(t, s, file_len)).withField("shown", tr.first_sample(t, file_len)).withField("length", tr.duration_of(t, movie_scale, movie_duration))))
    return F.transform(first, lambda t: t.withField("frames", F.when(t["error"].isNull(), tr.frames(t, t["samples"], movie_scale))).withField("repetitions", tr.repetitions(t, t["length"])))


def sealed(rows: DataFrame) -> DataFrame:
    """The same rows, through a sample of all of them: filters behind it stay behind it. Otherwise each would be pushed below the steps
    here, with the expressions of every step written out in place of its names, and those of a track are used many times."""
    return rows.sample(fraction=1.0, seed=0)


def with_roles(rows: DataFrame, limits) -> DataFrame:
    """Rows of files with their tracks told, `roles`, `matches` (whether alpha is in step with the image; null without alpha) and
    `usable` (whether the movie can be shown)."""
    rows = rows.withColumn("told", told(F.col("tracks"), F.col("file_len"), F.col("movie_timescale"), F.col("movie_duration")))
    rows = rows.withColumn("roles", tr.role_numbers(F.col("told"), limits))
    at = lambda name: F.get(F.col("told"), F.col(f"roles.{name}"))
    rows = rows.withColumn("matches", F.when(F.col("roles.alpha").isNotNull(), let(F.struct(at("image").alias("i"), at("alpha").alias("a")), lambda x: tr.same_times(x["i"], x["a"]))))
    no_alpha = F.col("roles.alphas") == 0
    sound = lambda name: let(at(name), lambda t: t["error"].isNull() & t["shown"].isNotNull())
    alpha = F.coalesce(sound("alpha") & F.col("matches"), F.lit(False))
    return sealed(rows.withColumn("usable", F.coalesce(sound("image") & (no_alpha | alpha), F.lit(False))))


def _struct(of: str, **values: Column) -> Column:
    """A row of a table of the schema; what isn't given is null."""
    fields = T.StructType.fromDDL(of).fields
    return F.struct(*[(values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def made(rows: DataFrame) -> Column:
    """(id, no, track) of the items to add to a file: its image, alpha and thumbnail, those that are there, in this order."""
    numbers = F.filter(F.array("roles.image", "roles.alpha", "roles.thumbnail"), lambda n: n.isNotNull())
    free = F.array_except(F.sequence(F.lit(HIGHEST).cast("bigint"), F.lit(HIGHEST - 2).cast("bigint") - F.size("nodes"), F.lit(-1).cast("bigint")), F.transform("nodes", lambda n: n["item_id"]))
    ids = F.when(F.col("has_meta"), free).otherwise(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint")))
    return let(ids, lambda free_ids: F.transform(numbers, lambda n, i: F.struct(F.get(free_ids, i).alias("id"), (F.size("nodes") + i).alias("no"), F.get(F.col("told"), n).alias("t"), (n == F.col("roles.thumbnail")).alias("small"))))


def with_movies(rows: DataFrame, limits) -> DataFrame:
    """Rows of parsed files; those with a movie that can be shown have its items in all tables, and `movie`: (image, alpha, thumbnail), the
    ids of these items. Their primary item is the image where there are no still images."""
    out = with_roles(rows, limits)
    some = F.filter(made(out), lambda m: F.col("usable"))
    added = F.transform(some, lambda m: F.struct(m["id"].alias("id"), m["no"].alias("no"), F.coalesce(m["small"], F.lit(False)).alias("small"), *[m["t"][k].alias(k) for k in ("width", "height", "hvcc", "av1c", "colr", "shown")]))
    out = out.withColumn("added", F.when(F.size("tracks") > 0, added).otherwise(F.slice(added, 1, 0))).drop("told")
    add = F.col("added")

    def props_of(m: Column) -> Column:
        one = lambda kind, value: _struct(ROWS["props"], kind=F.lit(kind), **{kind: value})
        codec = F.when(m["av1c"].isNotNull(), one("av1c", m["av1c"])).otherwise(one("hvcc", m["hvcc"]))
        return F.filter(F.array(one("ispe", F.struct(m["width"].alias("width"), m["height"].alias("height"))), codec, one("colr", m["colr"])), lambda p: (p["kind"] != "colr") | p["colr"].isNotNull())

    new_props = F.flatten(F.transform(add, props_of))
    count = lambda m: 2 + m["colr"].isNotNull().cast("int")
    base = lambda i: F.aggregate(F.slice(add, 1, i), F.size("props"), lambda a, m: a + count(m))
    numbers = lambda m, i: F.sequence(base(i) + 1, base(i) + count(m))
    kind_of = lambda m: F.when(m["av1c"].isNotNull(), "av01").otherwise("hvc1")
    empty, none = F.lit(""), F.array()
    ord_of = lambda table, name, i: F.coalesce(F.array_max(F.transform(table, lambda r: r[name])) + 1, F.lit(0)) + i
    item = lambda m, i: _struct(ROWS["items"], ord=ord_of("items", "ord", i), item_id=m["id"], item_type=kind_of(m), name=empty, content_type=empty, hidden=F.lit(False))
    node = lambda m, i: _struct(NESTED["nodes"], ord=ord_of("items", "ord", i), item_id=m["id"], item_type=kind_of(m), name=empty, content_type=empty, hidden=F.lit(False), props=numbers(m, i), dimg=none, dimg_no=none, loc=F.size("locations") + i)
    place = lambda m: F.struct(m["shown"]["offset"].cast("decimal(38,0)").alias("at"), m["shown"]["size"].cast("decimal(20,0)").alias("length"))
    location = lambda m: _struct(NESTED["locations"], item_id=m["id"], method=F.lit(0), parts=F.array(place(m)))
    extent = lambda m, i: _struct(ROWS["extents"], loc_ord=ord_of("extents", "loc_ord", i), item_id=m["id"], method=F.lit(0), base_offset=F.lit(0), ext_no=F.lit(0), offset=m["shown"]["offset"], length=m["shown"]["size"])
    assoc = lambda m, i: let(ord_of("assocs", "assoc_ord", i), lambda o: F.transform(numbers(m, i), lambda p, pos: _struct(ROWS["assocs"], assoc_ord=o, item_id=m["id"], pos=pos, prop_idx=p, essential=F.lit(False))))
    small = F.filter(add, lambda m: m["small"])
    image = F.get(add, F.lit(0))["id"]
    ref = lambda m: _struct(ROWS["refs"], ref_ord=ord_of("refs", "ref_ord", F.lit(0)), ref_type=F.lit("thmb"), from_id=m["id"], pos=F.lit(0), to_id=image)
    link = lambda m: _struct(NESTED["links"], ref_type=F.lit("thmb"), from_id=m["id"], from_no=m["no"], targets=F.array(F.struct(ord_of("refs", "ref_ord", F.lit(0)).alias("ref_ord"), F.lit(0).alias("pos"), image.alias("to_id"))))
    more = {
        "items": F.transform(add, item), "nodes": F.transform(add, node), "locations": F.transform(add, location), "extents": F.transform(add, extent), "assocs": F.flatten(F.transform(add, assoc)),
        "refs": F.transform(small, ref), "links": F.transform(small, link), "props": F.transform(new_props, lambda p, i: p.withField("prop_idx", (F.size("props") + i + 1).cast("int"))),
    }
    there = F.size(add) > 0
    first = there & ~F.coalesce(F.col("has_meta"), F.lit(False))
    alpha = F.when(F.col("roles.alpha").isNotNull(), F.get(add, F.lit(1))["id"])
    changed = {k: F.when(there, F.concat(F.col(k), v)).otherwise(F.col(k)) for k, v in more.items()}
    changed |= {"primary_id": F.when(first, image).otherwise(F.col("primary_id")), "primary_no": F.when(first, F.get(add, F.lit(0))["no"]).otherwise(F.col("primary_no"))}
    movie = F.when(there, F.struct(image.alias("image"), alpha.alias("alpha"), F.get(small, F.lit(0))["id"].alias("thumbnail")))
    # under other names first, as a name inside a lambda would mean a column made before it in the same select
    out = out.select(*[changed.get(c, F.col(c)).alias(f"new_{c}") for c in rows.columns], movie.alias("movie"))
    return sealed(out.select(*[F.col(f"new_{c}").alias(c) for c in rows.columns], "movie"))
