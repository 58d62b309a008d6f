"""Items: what a file's tables say about them, as expressions on the nested rows of that file.

A file's tables are arrays in one row, so nothing here joins or groups: rows stay where they were parsed, and bytes of a file are cut
in the row that holds them. Where a table has several rows for an item, the first counts; of several properties of a kind, the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.arrays import let
from boxloom.sources.container import ALPHA_HEVC, ALPHA_URN, Limits
from boxloom.sources.schema import MEMBERS
from boxloom.sources.tables import Container

#: The name of gain maps, item types that stand for others, and depths to which those are followed.
GAIN_MAP = "urn:com:apple:photo:2020:aux:hdrgainmap"
DERIVED = ("grid", "iden", "tmap")
PROBE_DEPTH, PROBE_KIDS = 8, 8
KINDS = {"avif": ("avif", "avis"), "heic": ("heic", "heix", "hevc", "hevx"), "sequence": ("msf1",)}
INFO = ("item_id", "ord", "item_type", "name", "content_type", "hidden")


def kind(brands: Column, is_sequence: Column) -> Column:
    """The kind of a file from its major and first 15 compatible brands."""
    first = F.slice(brands, 1, 16)
    out = F.when(is_sequence, "sequence")
    for name, of in KINDS.items():
        out = out.when(F.arrays_overlap(first, F.array(*map(F.lit, of))), name)
    return out.otherwise("heif")


def properties(numbers: Column) -> Column:
    """The properties of these numbers, in their order; numbers without one are left out."""
    return F.filter(F.transform(numbers, lambda i: F.get(F.col("props"), i - 1)), lambda p: p.isNotNull())


def last_of(some: Column, name: str) -> Column:
    return F.try_element_at(F.filter(some, lambda p: p["kind"] == name), F.lit(-1))[name]


def resolved(node: Column) -> Column:
    """A struct of what is told of an item: its first row, one field for each kind of property, and its transforms."""

    def of(mine: Column) -> Column:
        at = F.transform(mine, lambda p, i: F.struct(i.alias("pos"), p["kind"].alias("kind"), p["clap"].alias("clap"), p["irot"].alias("irot"), p["imir"].alias("imir")))
        steps = F.slice(F.filter(at, lambda p: p["kind"].isin("clap", "irot", "imir")), 1, 8)
        return F.struct(*[node[k].alias(k) for k in INFO], *[last_of(mine, k).alias(k) for k in MEMBERS], steps.alias("transforms"))

    return let(properties(node["props"]), of)


def resolved_items(c: Container) -> DataFrame:
    """(file_id, item_id, ord, item_type, name, content_type, hidden, one column for each property kind, transforms)."""
    return c.parsed.select("file_id", F.explode(F.transform("nodes", resolved)).alias("r")).select("file_id", "r.*")


def references(c: Container, ref_type: str, most: int | None = None) -> DataFrame:
    """(file_id, from_id, no, to_id) of a type in their order, `most` of each item at the most."""
    rows = c.parsed.select("file_id", F.explode(F.filter("links", lambda x: x["ref_type"] == ref_type)).alias("x"))
    listed = rows.select("file_id", F.col("x.from_id").alias("from_id"), F.posexplode(F.slice("x.targets", 1, most) if most else F.col("x.targets")).alias("no", "r"))
    return listed.select("file_id", "from_id", "no", F.col("r.to_id").alias("to_id"))


def fits(node: Column, urn: str | None) -> Column:
    """Whether an auxiliary item's name begins with urn; one without a name fits any, a missing item none."""
    named = F.lit(True) if urn is None else let(last_of(properties(node["props"]), "auxc"), lambda a: F.coalesce(a["aux_type"].startswith(urn), F.lit(True)))
    return node.isNotNull() & named


def auxiliaries(c: Container, urn: str | None = None) -> DataFrame:
    """(file_id, target_id, item_id, ref_ord, pos): items that are auxiliary to another and whose name begins with urn; one without a name fits any."""
    found = F.filter("links", lambda x: (x["ref_type"] == "auxl") & fits(F.get(F.col("nodes"), x["from_no"]), urn))
    return _targets(c, found)


def thumbnails(c: Container) -> DataFrame:
    return _targets(c, F.filter("links", lambda x: x["ref_type"] == "thmb"))


def _targets(c: Container, links: Column) -> DataFrame:
    rows = c.parsed.select("file_id", F.explode(links).alias("x")).select("file_id", F.col("x.from_id").alias("item_id"), F.explode("x.targets").alias("t"))
    return rows.select("file_id", F.col("t.to_id").alias("target_id"), "item_id", F.col("t.ref_ord").alias("ref_ord"), F.col("t.pos").alias("pos"))


def first_with(ref_type: str, target: Column, urn: str | None = None) -> Column:
    """The item of the first reference of a type to the target, in the order of references; null if there is none."""
    named = (lambda x: fits(F.get(F.col("nodes"), x["from_no"]), urn)) if ref_type == "auxl" else lambda x: F.lit(True)
    mine = F.filter("links", lambda x: (x["ref_type"] == ref_type) & F.exists(x["targets"], lambda t: t["to_id"] == target) & named(x))
    placed = F.transform(mine, lambda x: F.struct(F.array_min(F.transform(F.filter(x["targets"], lambda t: t["to_id"] == target), lambda t: F.struct(t["ref_ord"], t["pos"]))).alias("at"), x["from_id"].alias("id")))
    return F.array_min(placed)["id"]


def payload(location: Column) -> Column:
    """A struct (payload, error) of an item's location: its extents joined in order, from the file or from idat. Needs the file's content."""
    method, parts = location["method"], location["parts"]
    size = F.when(method == 0, F.col("file_len")).when(method == 1, F.col("idat_len"))
    start = F.when(method == 0, F.lit(0)).otherwise(F.col("idat_off"))
    inside = F.forall(parts, lambda p: p["at"] + p["length"] <= size)
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, p: (a + p["length"]).cast("decimal(38,0)"))
    error = F.when(F.size(parts) == 0, "no extents").when(method > 1, "an unknown construction method").when(size.isNull(), "no idat").when(~inside | (total > size), "an extent leaves the data")
    cut = F.transform(parts, lambda p: F.substring(F.col("content"), (start + p["at"] + 1).cast("int"), p["length"].cast("int")))
    # most items have one extent; of several the pieces are put together at once, by their hexadecimal digits
    whole = F.when(F.size(parts) == 1, F.get(cut, F.lit(0))).otherwise(F.unhex(F.array_join(F.transform(cut, F.hex), "")))
    return let(error, lambda e: F.struct(F.when(e.isNull(), whole).alias("payload"), e.alias("error")))


def payloads(c: Container) -> DataFrame:
    """(file_id, item_id, payload, error): the bytes of each item that has a location."""
    each = F.transform("locations", lambda x: let(payload(x), lambda p: F.struct(x["item_id"].alias("item_id"), p["payload"].alias("payload"), p["error"].alias("error"))))
    return c.whole.select("file_id", F.explode(each).alias("r")).select("file_id", "r.*")


def node_payload(node: Column) -> Column:
    """payload() of an item, null without a location."""
    return F.when(node["loc"].isNotNull(), payload(F.get(F.col("locations"), node["loc"])))


def item_payloads(c: Container) -> DataFrame:
    """(file_id, item_id, item_type, name, content_type, hidden, payload, error) of each item that has a location."""
    there = F.filter("nodes", lambda n: n["loc"].isNotNull())
    each = F.transform(there, lambda n: let(node_payload(n), lambda p: F.struct(*[n[k].alias(k) for k in INFO if k != "ord"], p["payload"].alias("payload"), p["error"].alias("error"))))
    return c.whole.select("file_id", F.explode(each).alias("r")).select("file_id", "r.*")


def display_size(width: Column, height: Column, transforms: Column) -> Column:
    """Width and height behind the transforms: quarter turns swap them, an aperture replaces them."""

    def step(a: Column, t: Column) -> Column:
        cw, ch = F.call_function("div", t["clap"]["width_n"], t["clap"]["width_d"]), F.call_function("div", t["clap"]["height_n"], t["clap"]["height_d"])
        turned = (t["kind"] == "irot") & t["irot"]["angle"].isin(90, 270)
        cut = (t["kind"] == "clap") & (cw > 0) & (ch > 0)
        return F.when(turned, F.struct(a["h"].alias("w"), a["w"].alias("h"))).when(cut, F.struct(cw.alias("w"), ch.alias("h"))).otherwise(a)

    return F.aggregate(transforms, F.struct(width.alias("w"), height.alias("h")), step)


def probed(node: Column) -> Column:
    """What following dimg references needs to know of an item."""

    def of(mine: Column) -> Column:
        has = lambda *names: F.exists(mine, lambda p: p["kind"].isin(*names))
        return F.struct(node["item_type"].isin(*DERIVED).alias("derived"), has("ispe").alias("sized"), has("hvcc", "av1c").alias("coded"), F.slice(node["dimg_no"], 1, PROBE_KIDS).alias("kids"))

    return let(properties(node["props"]), of)


def first_sized(start: Column, nodes: Column) -> Column:
    """The number of the item along first dimg references from start that has a size; null where the chain ends, comes round or is too long."""

    def step(s: Column, _: Column) -> Column:
        n = F.get(nodes, s["no"])
        ends = ~n["derived"] | (F.size(s["seen"]) >= PROBE_DEPTH) | F.array_contains(s["seen"], s["no"]) | (F.size(n["kids"]) == 0)
        on = F.struct(F.get(n["kids"], F.lit(0)).alias("no"), F.array_append(s["seen"], s["no"]).alias("seen"))
        stop = F.struct(F.lit(None).cast("int").alias("no"), s["seen"].alias("seen"))
        return F.when(s["no"].isNull() | n["sized"], s).when(n.isNull() | F.coalesce(ends, F.lit(True)), stop).otherwise(on)

    begin = F.struct(start.alias("no"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(PROBE_DEPTH)), begin, step, lambda s: s["no"])


def first_coded(start: Column, nodes: Column) -> Column:
    """The number of the first item with a codec, depth first over up to eight children of each derived item; null where there is none.

    An item that was opened in vain is opened again only where fewer steps led to it, so a file with d derived items takes at most
    64 d + 1 steps."""
    entry = lambda no, depth: F.struct(no.alias("no"), depth.alias("depth"))

    def step(s: Column, _: Column) -> Column:
        top = F.get(s["stack"], F.lit(0))
        rest = F.slice(s["stack"], 2, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        n = F.get(nodes, top["no"])
        more = n["derived"] & (top["depth"] < PROBE_DEPTH) & ~F.exists(s["tried"], lambda t: (t["no"] == top["no"]) & (t["depth"] <= top["depth"]))
        kids = F.transform(F.filter(n["kids"], lambda k: k.isNotNull()), lambda k: entry(k, top["depth"] + 1))
        state = lambda stack, tried, found: F.struct(stack.alias("stack"), tried.alias("tried"), found.alias("found"))
        return (
            F.when(s["found"].isNotNull() | (F.size(s["stack"]) == 0), s).when(n["coded"], state(rest, s["tried"], top["no"]))
            .when(more, state(F.concat(kids, rest), F.array_append(s["tried"], top), s["found"])).otherwise(state(rest, s["tried"], s["found"]))
        )

    begin = F.struct(F.filter(F.array(entry(start, F.lit(0))), lambda x: x["no"].isNotNull()).alias("stack"), F.filter(F.array(entry(F.lit(0), F.lit(0))), lambda _: F.lit(False)).alias("tried"), F.lit(None).cast("int").alias("found"))
    steps = F.size(F.filter(nodes, lambda n: F.coalesce(n["derived"], F.lit(False)))) * PROBE_DEPTH * PROBE_KIDS + 1
    return F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda s: s["found"])


def info(c: Container) -> DataFrame:
    """What can be told of each file's primary image without decoding it; an error where nothing can. Files with a movie that can be shown
    are sequences; those without still images have the movie's image for their primary one.

    (file_id, kind, width, height, bit_depth, has_alpha, has_exif, has_xmp, has_thumbnail, has_gain_map, color_primaries,
    transfer_characteristics, matrix_coefficients, full_range, rgb_bytes, rgba_bytes, within_limits, error)"""
    primary, parse_error = F.col("primary_id"), F.col("error")
    with_nodes = c.parsed.withColumn("probed", F.transform("nodes", probed))
    found = with_nodes.withColumn("own_no", F.when(parse_error.isNull(), F.col("primary_no"))).withColumn("sized_no", first_sized(F.col("own_no"), F.col("probed"))).withColumn("coded_no", first_coded(F.col("own_no"), F.col("probed")))
    item = lambda name: F.when(F.col(name).isNotNull(), resolved(F.get(F.col("nodes"), F.col(name))))
    rows = found.select("file_id", "movie", "brand", "brands", parse_error.alias("parse_error"), "primary_id", "own_no", "items", "links", "nodes", "props", item("sized_no").alias("sized"), item("coded_no").alias("coded"), item("own_no").alias("own"))
    ref = lambda name, urn=None: F.coalesce(first_with(name, primary, urn).isNotNull(), F.lit(False))
    xmp_type = lambda i: (i["item_type"] == "mime") & (F.contains(i["content_type"], F.lit("xmp")) | F.contains(i["content_type"], F.lit("rdf+xml")))
    rows = rows.select(
        "file_id", "movie", "brand", "brands", "parse_error", "own_no", F.when(F.col("sized.ispe").isNotNull(), display_size(F.col("sized.ispe.width"), F.col("sized.ispe.height"), F.col("sized.transforms"))).alias("size"),
        F.coalesce("coded.hvcc.bit_depth", "coded.av1c.bit_depth").alias("depth"), F.col("own.colr").alias("colr"), F.col("coded.colr").alias("coded_colr"),
        F.exists("items", lambda i: i["item_type"] == "Exif").alias("has_exif"), F.exists("items", xmp_type).alias("has_xmp"), ref("thmb").alias("has_thumbnail"), (ref("auxl", ALPHA_URN) | ref("auxl", ALPHA_HEVC) | F.col("movie.alpha").isNotNull()).alias("has_alpha"), ref("auxl", GAIN_MAP).alias("has_gain_map"),
    )
    nclx = F.when(F.col("colr.kind") == "nclx", F.col("colr")).when(F.col("coded_colr.kind") == "nclx", F.col("coded_colr"))
    error = F.coalesce("parse_error", F.when(F.col("own_no").isNull(), "no primary item"), F.when(F.col("size").isNull(), "the primary item has no size"))
    w, h = F.col("size.w"), F.col("size.h")
    flag = lambda name: F.when(error.isNull(), F.coalesce(F.col(name), F.lit(False))).alias(name)
    lim: Limits = c.limits
    return rows.select(
        "file_id", F.when(F.col("parse_error").isNull(), kind(F.concat(F.array("brand"), "brands"), F.col("movie").isNotNull())).alias("kind"), w.alias("width"), h.alias("height"), F.when(error.isNull(), F.coalesce("depth", F.lit(8))).alias("bit_depth"),
        *map(flag, ("has_alpha", "has_exif", "has_xmp", "has_thumbnail", "has_gain_map")),
        nclx["primaries"].alias("color_primaries"), nclx["transfer"].alias("transfer_characteristics"), nclx["matrix"].alias("matrix_coefficients"), nclx["full_range"].alias("full_range"),
        (w * h * 3).alias("rgb_bytes"), (w * h * 4).alias("rgba_bytes"), ((w <= lim.width) & (h <= lim.height) & (w * h <= lim.pixels)).alias("within_limits"), error.alias("error"),
    )


def exif_of(nodes: Column) -> Column:
    """The first Exif item's TIFF data, those whose offset leaves the item passed over. Needs the file's content."""
    data = F.transform(F.filter(nodes, lambda n: n["item_type"] == "Exif"), lambda n: node_payload(n)["payload"])
    at = lambda p: F.conv(F.hex(F.substring(p, 1, 4)), 16, 10).cast("bigint") + 4
    good = F.filter(data, lambda p: (F.length(p) > 4) & (at(p) < F.length(p)))
    return let(F.get(good, F.lit(0)), lambda p: F.substring(p, (at(p) + 1).cast("int"), F.length(p)))


def exif(c: Container) -> DataFrame:
    """(file_id, exif) of files that have such an item."""
    return c.whole.select("file_id", exif_of(F.col("nodes")).alias("exif")).where("exif is not null")


def xmp_of(nodes: Column) -> Column:
    """The first item of type mime whose content type names XMP. Needs the file's content."""
    named = lambda n: (n["item_type"] == "mime") & (F.contains(n["content_type"], F.lit("xmp")) | F.contains(n["content_type"], F.lit("rdf+xml")))
    data = F.transform(F.filter(nodes, named), lambda n: node_payload(n)["payload"])
    return F.get(F.filter(data, lambda p: p.isNotNull()), F.lit(0))


def xmp(c: Container) -> DataFrame:
    """(file_id, xmp) of files that have such an item."""
    return c.whole.select("file_id", xmp_of(F.col("nodes")).alias("xmp")).where("xmp is not null")


def icc_of(primary: Column) -> Column:
    """A primary item's profile: the last colour property if it is one, else the first profile among all."""
    mine = F.filter("assocs", lambda a: a["item_id"] == primary)

    def of(rows: Column) -> Column:
        used = F.filter(rows, lambda a: a["assoc_ord"] == F.get(rows, F.lit(0))["assoc_ord"])
        colours = lambda some: F.transform(F.filter(properties(F.transform(some, lambda a: a["prop_idx"])), lambda p: p["kind"] == "colr"), lambda p: p["colr"])
        last, first = F.try_element_at(colours(used), F.lit(-1)), F.get(F.filter(colours(rows), lambda x: x["kind"] == "icc"), F.lit(0))
        return F.when(last["kind"] == "icc", last["icc"]).otherwise(first["icc"])

    return let(mine, of)


def icc(c: Container) -> DataFrame:
    """(file_id, icc) of files whose primary item has a profile."""
    return c.parsed.select("file_id", icc_of(F.col("primary_id")).alias("icc")).where("icc is not null")


def metadata(c: Container) -> DataFrame:
    """(file_id, exif, xmp, icc) of each file, null where there is none; one look at each file."""
    return c.whole.select("file_id", exif_of(F.col("nodes")).alias("exif"), xmp_of(F.col("nodes")).alias("xmp"), icc_of(F.col("primary_id")).alias("icc"))
