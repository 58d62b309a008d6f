"""Pixels of files: primary images, thumbnails and gain maps, with derived images, transforms and alpha.

All rows of a file meet in one row of nested items, and one Arrow kernel decodes it; files are spread over the cluster. A picture that
can't be decoded has an error. Uncompressed images are decoded here; HEVC and AV1 are reported as unsupported."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.operators import frames as fr
from boxloom.operators.unci import Unsupported
from boxloom.operators.unci import decode as decode_unci
from boxloom.plans.items import GAIN_MAP, first_with, let, node_payload, resolved
from boxloom.sources.boxes import Fields, Short
from boxloom.sources.container import ALPHA_HEVC, ALPHA_URN, Limits
from boxloom.sources.tables import Container

#: How deep derived images may be nested, and how many tiles and layers they may have.
DEPTH, MOST_TILES, MOST_LAYERS = 4, 512, 64


class File:
    """The resolved items of one file, and how to decode them."""

    def __init__(self, items: list[dict], limits: Limits, native: bool = False):
        self.items, self.limits, self.native = {i["item_id"]: i for i in items}, limits, native

    def payload(self, item: dict) -> bytes:
        if item["payload"] is None:
            raise ValueError(item["payload_error"] or "the item has no payload")
        return item["payload"]

    def item(self, n: int) -> dict:
        if n not in self.items:
            raise ValueError(f"item {n} is missing")
        return self.items[n]

    def decode(self, item: dict, depth: int = 0) -> fr.Frame:
        if depth > DEPTH:
            raise ValueError("derived images are nested too deep")
        kind = item["item_type"]
        if kind == "grid":
            f = self.grid(item, depth)
        elif kind == "iovl":
            return fr.transform(self.overlay(item, depth), item["transforms"])
        elif kind in ("iden", "tmap"):
            if not item["dimg"]:
                raise ValueError("a derived image has no source")
            f = self.decode(self.item(item["dimg"][0]), depth + 1)
        elif kind == "unci":
            if not item["ispe"] or not item["uncc"]:
                raise ValueError("an uncompressed image has no size or layout")
            w, h = item["ispe"]["width"], item["ispe"]["height"]
            if not self.limits.allow(w, h):
                raise ValueError("the image is too large")
            f = decode_unci(item["uncc"], item["cmpc"], item["cmpd"], item["icef"], self.payload(item), w, h, self.limits.memory, self.native)
        elif kind in ("hvc1", "hev1", "av01"):
            raise Unsupported("hevc pixels are unsupported" if kind != "av01" else "av1 pixels are unsupported")
        else:
            raise Unsupported(f"items of type {kind} hold no picture")
        c = item["colr"]
        if c and c["kind"] == "nclx":
            f = replace(f, primaries=c["primaries"], transfer=c["transfer"], matrix=c["matrix"], full_range=c["full_range"])
        return fr.transform(f, item["transforms"])

    def grid(self, item: dict, depth: int) -> fr.Frame:
        rows, cols, width, height = grid_layout(self.payload(item))
        if not self.limits.allow(width, height):
            raise ValueError("the grid is too large")
        if rows * cols > MOST_TILES or len(item["dimg"]) < rows * cols:
            raise ValueError("the grid's tiles are too many or too few")
        first = self.item(item["dimg"][0])
        if not first["ispe"]:
            raise ValueError("the grid's first tile has no size")
        codec = first["hvcc"] or first["av1c"]
        if not codec:
            raise Unsupported("the grid's tiles have no codec")
        tw, th = shown_size(first)
        chroma = first["hvcc"]["chroma_format"] if first["hvcc"] else 0 if codec["monochrome"] else 3 if not codec["subsampling_x"] else 1 if codec["subsampling_y"] else 2
        out = fr.blank(width, height, codec["bit_depth"], chroma)
        for k, n in enumerate(item["dimg"][: rows * cols]):
            tile = self.decode(self.item(n), depth + 1)
            if k == 0:
                out = replace(out, full_range=tile.full_range, matrix=tile.matrix, primaries=tile.primaries, transfer=tile.transfer)
            fr.paste(out, tile, k % cols * tw, k // cols * th)
        return out

    def overlay(self, item: dict, depth: int) -> fr.Frame:
        ids = item["dimg"][:MOST_LAYERS]
        fill, width, height, offsets = overlay_layout(self.payload(item), len(ids))
        if not ids or not self.limits.allow(width, height):
            raise ValueError("the overlay has no layers, or is too large")
        first = self.item(ids[0])["hvcc"]
        bits, chroma_bits, chroma = (first["bit_depth"], first["bit_depth_chroma"], first["chroma_format"]) if first else (8, 8, 1)
        neutral = 128 << max(chroma_bits - 8, 0)
        out = fr.blank(width, height, bits, chroma, chroma_bits, ((fill >> 8) << max(bits - 8, 0), neutral, neutral))
        for k, (n, (x, y)) in enumerate(zip(ids, offsets, strict=True)):
            layer = self.decode(self.item(n), depth + 1)
            if k == 0:
                out = replace(out, full_range=layer.full_range, matrix=layer.matrix)
            fr.paste(out, layer, x, y)
        return out

    def picture(self, n: int, alpha: int | None = None) -> tuple[fr.Frame, str | None]:
        """An item's frame, with its alpha; alpha that can't be decoded is told and left out."""
        f, warning = self.decode(self.item(n)), None
        if alpha is not None:
            try:
                f = fr.attach_alpha(f, self.decode(self.item(alpha), 1))
            except (ValueError, Short) as e:
                warning = f"alpha: {e}"
        return f, warning


def grid_layout(data: bytes) -> tuple[int, int, int, int]:
    """Rows, columns, width and height."""
    f = Fields(data)
    f.u(1)
    wide = 4 if f.u(1) & 1 else 2
    return f.u(1) + 1, f.u(1) + 1, f.u(wide), f.u(wide)


def overlay_layout(data: bytes, layers: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Fill, width, height and the layers' places; a list of places that ends early is an error."""
    f = Fields(data)
    if f.u(1):
        raise Unsupported("the overlay's version is unknown")
    wide = 4 if f.u(1) & 1 else 2
    fill = f.u(2)
    f.take(6)
    return fill, f.u(wide), f.u(wide), [(f.s(wide), f.s(wide)) for _ in range(layers)]


def shown_size(item: dict) -> tuple[int, int]:
    w, h = item["ispe"]["width"], item["ispe"]["height"]
    for t in item["transforms"]:
        if t["kind"] == "irot" and t["irot"]["angle"] in (90, 270):
            w, h = h, w
        elif t["kind"] == "clap":
            cw, ch = t["clap"]["width_n"] // t["clap"]["width_d"], t["clap"]["height_n"] // t["clap"]["height_d"]
            w, h = (cw, ch) if cw and ch else (w, h)
    return w, h


#: Bytes held for each sample of an item while it is decoded: positions and values of a plane at a time, planes, and packed pixels.
HELD = 48


def cost(items: Column) -> Column:
    """At least as many bytes as decoding some items holds at once: their payloads, and what their samples take."""
    one = lambda i: F.coalesce(F.length(i["payload"]), F.lit(0)) + F.coalesce(i["ispe"]["width"].cast("decimal(20,0)") * i["ispe"]["height"], F.lit(0)) * HELD
    return F.aggregate(items, F.lit(0).cast("decimal(38,0)"), lambda a, i: (a + one(i)).cast("decimal(38,0)"))


IMAGE = "role string, width int, height int, format string, stride int, data binary, warning string, error string"


def pictures(c: Container, form: str = "rgb", roles: tuple[str, ...] = ("primary",)) -> DataFrame:
    """(file_id, role, width, height, format, stride, data, warning, error) of each file's primary image, thumbnail and gain map."""

    def made(file: File, n: int, alpha: int | None) -> dict:
        f, warning = file.picture(n, alpha if len(form) == 4 else None)
        px = np.ascontiguousarray(fr.to_pixels(f, form))
        return {"width": px.shape[1], "height": px.shape[0], "stride": px.shape[1] * len(form), "data": px.tobytes(), "warning": warning}

    return _decoded(c, roles, IMAGE, made, {"format": form})


#: Planes of a picture in the order of luma, Cb, Cr, alpha; samples of more than 8 bits take two bytes, the low one first.
PLANES = "role string, planes array<struct<name: string, width: int, height: int, depth: int, data: binary>>, error string"


def planes(c: Container, roles: tuple[str, ...] = ("primary",)) -> DataFrame:
    """(file_id, role, planes, error): pictures as planes at the depth of their samples, cut to what is shown; chroma has its own size."""

    def made(file: File, n: int, alpha: int | None) -> dict:
        file.native = True
        f, _ = file.picture(n, alpha)
        if f.width <= 0 or f.height <= 0:
            raise ValueError("the crop leaves nothing")
        out, (kx, ky), (left, _, top, _) = [], fr.STEPS[f.chroma], f.crop
        for name, plane, sx, sy, depth in (("y", f.y, 1, 1, f.depth), ("cb", f.cb, kx, ky, f.chroma_depth), ("cr", f.cr, kx, ky, f.chroma_depth), ("a", f.a, 1, 1, f.depth)):
            if plane is None or name in ("cb", "cr") and f.chroma == 0:
                continue
            cut = plane[top // sy : top // sy + -(-f.height // sy), left // sx : left // sx + -(-f.width // sx)]
            unset = (1 << depth) - 1 if name == "a" else 0 if name == "y" else 1 << depth - 1
            cut = np.where(cut == fr.UNSET, unset, cut).astype("<u2" if depth > 8 else "u1")
            out.append({"name": name, "width": cut.shape[1], "height": cut.shape[0], "depth": depth, "data": cut.tobytes()})
        return {"planes": out}

    return _decoded(c, roles, PLANES, made, {})


def raw(images: DataFrame) -> DataFrame:
    """(file_id, role, raw): the planes of planes(), one behind the other, as files of raw pictures have them."""
    part = lambda i: F.coalesce(F.get("planes", F.lit(i))["data"], F.lit(b""))
    return images.where("error is null").select("file_id", "role", F.concat(*map(part, range(4))).alias("raw"))


def needed_bytes(width: Column, height: Column, form: Column, stride: Column) -> Column:
    """How many bytes a picture takes with rows that begin `stride` bytes apart, the last one without what follows it; null where a row
    takes more than that."""
    row = width * F.length(form)
    return F.when(stride >= row, stride.cast("bigint") * (height - 1) + row)


def at_stride(images: DataFrame, stride: Column) -> DataFrame:
    """Pictures with rows that begin `stride` bytes apart, zeros between; one whose rows take more has an error and no data."""
    row = F.col("width") * F.length("format")
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.hex(F.substring("data", y * row + 1, row)))
    gap = F.repeat(F.lit("00"), (stride - row).cast("int"))
    fits = F.coalesce(needed_bytes(F.col("width"), F.col("height"), F.col("format"), stride).isNotNull(), F.lit(False))
    data = F.when(fits, F.unhex(F.array_join(F.transform(lines, lambda x, y: F.when(y < F.col("height") - 1, F.concat(x, gap)).otherwise(x)), "")))
    error = F.coalesce("error", F.when(~fits, "the stride is too small"))
    return images.withColumns({"data": F.when(F.col("error").isNull(), data), "stride": F.when(fits, stride.cast("int")), "error": error})


#: Files that are Python objects at once, and rows and bytes of pictures that go on together.
FILES, MANY, LARGE = 64, 256, 4 << 20


def taken(row: dict) -> int:
    """Bytes of a picture's samples."""
    return len(row.get("data") or b"") + sum(len(p["data"]) for p in row.get("planes") or ())


def plain(a: pa.Array) -> list:
    """to_pylist(), a column of nested ones at a time: those that are null throughout, as most kinds of properties are, cost nothing."""
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_struct(a.type):
        names, columns = [f.name for f in a.type], [plain(x) for x in a.flatten()]
        out = [dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True)]
    elif pa.types.is_list(a.type):
        values, ends = plain(a.flatten()), np.cumsum(pc.fill_null(a.value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
        out = [values[x:y] for x, y in zip([0, *ends], ends, strict=False)]
    else:
        return a.to_pylist()
    return [x if there else None for x, there in zip(out, a.is_valid().to_pylist(), strict=True)] if a.null_count else out


def _decoded(c: Container, roles: tuple[str, ...], columns_of: str, make, also: dict) -> DataFrame:
    """A row for each file and role: what make(file, item, alpha) gives, or an error."""
    columns = ["item_id", "item_type", "ispe", "colr", "hvcc", "av1c", "uncc", "cmpc", "cmpd", "icef", "transforms"]

    def known(n: Column) -> Column:
        bytes_of = lambda r: let(node_payload(n), lambda p: F.struct(*[r[k].alias(k) for k in columns], F.slice(n["dimg"], 1, MOST_TILES).alias("dimg"), p["payload"].alias("payload"), p["error"].alias("payload_error")))
        return let(resolved(n), bytes_of)

    primary, none = F.col("primary_id"), F.lit(None).cast("bigint")
    alpha = F.coalesce(first_with("auxl", primary, ALPHA_URN), first_with("auxl", primary, ALPHA_HEVC))
    small = first_with("thmb", primary) if "thumbnail" in roles else none
    gain = first_with("auxl", primary, GAIN_MAP) if "gain_map" in roles else none
    # items and their payloads are put together in the row of their file, and decoded there
    out = c.whole.select("file_id", "primary_id", F.col("error").alias("parse_error"), F.transform("nodes", known).alias("items"), alpha.alias("alpha"), small.alias("thumbnail"), gain.alias("gain_map"))
    # a file that would hold too much is not handed to the kernel
    over = cost(F.col("items")) > F.lit(c.limits.memory).cast("decimal(38,0)")
    out = out.withColumn("parse_error", F.coalesce("parse_error", F.when(over, "the file needs more memory than allowed")))
    out = out.withColumn("items", F.when(F.col("parse_error").isNull(), F.col("items")))
    kind, limits = c.parsed.schema["file_id"].dataType, c.limits
    schema = T.StructType([T.StructField("file_id", kind), *T.StructType.fromDDL(columns_of).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for b in batches:
            # a few files at a time are Python objects; pictures go on once they are many, or large
            for row in (r for k in range(0, b.num_rows, FILES) for r in plain(b.slice(k, FILES).to_struct_array())):
                file = File(row["items"] or [], limits)
                for role, n in (("primary", row["primary_id"]), ("thumbnail", row["thumbnail"]), ("gain_map", row["gain_map"])):
                    if role not in roles or n is None and role != "primary":
                        continue
                    base = {"file_id": row["file_id"], "role": role} | also
                    try:
                        if row["parse_error"] is not None:
                            raise ValueError(row["parse_error"])
                        made.append(base | make(file, n, row["alpha"] if role == "primary" else None))
                    except (ValueError, Short) as e:
                        made.append(base | {"error": str(e) or "the data end too early"})
                    held += taken(made[-1])
                if len(made) >= MANY or held >= LARGE:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made, held = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return out.select("file_id", "primary_id", "parse_error", "items", "alpha", "thumbnail", "gain_map").mapInArrow(run, schema)


def pixels(images: DataFrame) -> DataFrame:
    """(file_id, role, x, y, ch, v): a row for each byte of each picture; for measures on small pictures."""
    n = F.length("format")
    rows = images.where("error is null").select("file_id", "role", "width", "stride", n.alias("n"), "data", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i"))
    row, at = F.call_function("div", F.col("i"), F.col("stride")).cast("int"), F.col("i") % F.col("stride")
    return rows.select("file_id", "role", F.call_function("div", at, F.col("n")).cast("int").alias("x"), row.alias("y"), (at % F.col("n")).cast("int").alias("ch"), F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias("v"))
