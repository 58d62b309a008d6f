"""Derived images without their pixels: in which order items have to be decoded, and which tiles of a grid a region needs.

Both are worked out in the row of a file. Tiles are found from the region by arithmetic, so a small region of a large grid touches few
tiles, and only their payloads are cut out of the file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.functions.arrays import let
from boxloom.plans.items import display_size, last_of, node_payload, properties
from boxloom.sources.container import ALPHA_HEVC, ALPHA_URN
from boxloom.sources.tables import Container

#: How deep items may depend on others, and how many tiles a grid may have.
DEPTH, MOST_TILES = 4, 512
DERIVED = ("grid", "iovl", "iden", "tmap")


def levels_of(items: list[int], needs: dict[int, list[int]]) -> dict[int, tuple[int | None, str | None]]:
    """(level, error) of each item: 0 without needs, else one above the highest of them. Items in a cycle, over one, or that need a missing
    item have no level; those over DEPTH have one, and an error. Each need is looked at once."""
    known = set(items)
    out: dict[int, tuple[int | None, str | None]] = {i: (None, f"item {lost} is missing") for i in items if (lost := next((n for n in needs.get(i, ()) if n not in known), None)) is not None}
    users: dict[int, list[int]] = {}
    open_needs = {i: len(set(needs.get(i, ()))) for i in items}
    for i in items:
        for n in set(needs.get(i, ())):
            users.setdefault(n, []).append(i)
    level = dict.fromkeys(items, 0)
    ready = [i for i in items if not open_needs[i]]
    while ready:
        n = ready.pop()
        if n not in out:
            out[n] = (level[n], "nested too deep" if level[n] > DEPTH else None)
        for user in users.get(n, ()):
            if out[n][0] is None:
                out.setdefault(user, (None, f"item {n} has no level"))
            level[user] = max(level[user], level[n] + 1)
            open_needs[user] -= 1
            if not open_needs[user]:
                ready.append(user)
    lost = [i for i in out if out[i][0] is None]
    while lost:  # what needs these has no level either, whether or not it hangs in a cycle, too
        n = lost.pop()
        for user in users.get(n, ()):
            if user not in out:
                out[user] = (None, f"item {n} has no level")
                lost.append(user)
    for i in items:
        out.setdefault(i, (None, "in a cycle, or over one"))
    return out


def order(c: Container) -> DataFrame:
    """(file_id, item_id, level, error) of each item: items of one level can be decoded at once, when those below are done. Derived images
    need their sources, predicted ones what they are predicted from, and pictures with alpha their alpha."""
    kind = c.parsed.schema["file_id"].dataType
    schema = T.StructType([T.StructField("file_id", kind), *T.StructType.fromDDL("item_id bigint, level int, error string").fields])
    arrow = to_arrow_schema(schema)
    alpha = lambda x: F.exists(properties(F.get(F.col("nodes"), x["from_no"])["props"]), lambda p: (p["kind"] == "auxc") & (p["auxc"]["aux_type"].startswith(ALPHA_URN) | p["auxc"]["aux_type"].startswith(ALPHA_HEVC)))
    derived = lambda x: F.coalesce(F.get(F.col("nodes"), x["from_no"])["item_type"].isin(*DERIVED), F.lit(False))
    used = F.filter("links", lambda x: (x["ref_type"] == "pred") | (x["ref_type"] == "dimg") & derived(x) | (x["ref_type"] == "auxl") & F.coalesce(alpha(x), F.lit(False)))
    edge = F.transform(used, lambda x: F.struct((x["ref_type"] == "auxl").alias("back"), x["from_id"].alias("from_id"), F.transform(x["targets"], lambda t: t["to_id"]).alias("to")))
    rows = c.parsed.where(F.size("nodes") > 0).select("file_id", F.transform("nodes", lambda n: n["item_id"]).alias("items"), edge.alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                needs: dict[int, list[int]] = {}
                for e in row["edges"]:
                    for to in e["to"]:
                        a, z = (to, e["from_id"]) if e["back"] else (e["from_id"], to)
                        needs.setdefault(a, []).append(z)
                out += [{"file_id": row["file_id"], "item_id": i, "level": level, "error": error} for i, (level, error) in levels_of(row["items"], needs).items()]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def _number(data: Column, at: Column | int, size: Column | int) -> Column:
    """An unsigned number of some bytes, at an offset from 0."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.conv(F.hex(F.substring(data, (lit(at) + 1).cast("int"), lit(size).cast("int"))), 16, 10).cast("bigint")


def layout(payload: Column) -> Column:
    """(rows, columns, width, height) of a grid's payload; null where it is too short."""
    wide = F.when(_number(payload, 1, 1) % 2 == 1, 4).otherwise(2)
    return F.when(F.length(payload) >= 8, let(wide, lambda n: F.when(F.length(payload) >= 4 + 2 * n, F.struct((_number(payload, 2, 1) + 1).alias("rows"), (_number(payload, 3, 1) + 1).alias("columns"), _number(payload, F.lit(4), n).alias("width"), _number(payload, 4 + n, n).alias("height")))))


def grids(c: Container) -> DataFrame:
    """Rows of files with their contents and `grids`: (item_id, tile_ids, rows, columns, width, height, tile_width, tile_height, error).

    All tiles have the display size of the first."""
    def of(n: Column) -> Column:
        first = F.get(F.col("nodes"), F.get(n["dimg_no"], F.lit(0)))
        mine = properties(first["props"])
        steps = F.transform(F.filter(mine, lambda p: p["kind"].isin("clap", "irot", "imir")), lambda p: F.struct(p["kind"].alias("kind"), p["clap"].alias("clap"), p["irot"].alias("irot"), p["imir"].alias("imir")))
        size = let(last_of(mine, "ispe"), lambda s: F.when(s.isNotNull(), display_size(s["width"], s["height"], F.slice(steps, 1, 8))))

        def told(x: Column) -> Column:
            g, s, lim = x["layout"], x["size"], c.limits
            count = g["rows"] * g["columns"]
            allowed = (g["width"] > 0) & (g["height"] > 0) & (g["width"] <= lim.width) & (g["height"] <= lim.height) & (g["width"] * g["height"] <= lim.pixels)
            error = F.coalesce(x["error"], F.when(g.isNull(), "the grid's layout ends early").when(~allowed, "the grid is too large").when((count > MOST_TILES) | (F.size(n["dimg"]) < count), "the grid's tiles are too many or too few").when(s.isNull(), "the grid's first tile has no size"))
            return F.struct(n["item_id"].alias("item_id"), n["dimg"].alias("tile_ids"), n["dimg_no"].alias("tile_no"), *[g[k].alias(k) for k in ("rows", "columns", "width", "height")], s["w"].alias("tile_width"), s["h"].alias("tile_height"), error.alias("error"))

        return let(let(node_payload(n), lambda p: F.struct(layout(p["payload"]).alias("layout"), size.alias("size"), F.when(p.isNull(), "the grid has no payload").otherwise(p["error"]).alias("error"))), told)

    return c.whole.withColumn("grids", F.transform(F.filter("nodes", lambda n: n["item_type"] == "grid"), of))


def region_tiles(c: Container, x0: Column, y0: Column, x1: Column, y1: Column, payloads: bool = False) -> DataFrame:
    """(file_id, item_id, no, tile_id, source_x, source_y, target_x, target_y, width, height, error), and with `payloads` the payload of each
    tile: what a region [x0, x1) x [y0, y1) of each grid needs. A tile gives the rectangle of this size that begins at its source place;
    it goes to its target place in the region, which is cut to the grid. A grid that can't be laid out has one row, with an error."""
    div = lambda a, b: F.call_function("div", a, b)

    def of(g: Column) -> Column:
        left, top = F.greatest(x0, F.lit(0)).cast("bigint"), F.greatest(y0, F.lit(0)).cast("bigint")
        right, bottom = F.least(x1.cast("bigint"), g["width"], g["columns"] * g["tile_width"]), F.least(y1.cast("bigint"), g["height"], g["rows"] * g["tile_height"])

        def tile(row: Column, column: Column) -> Column:
            no = (row * g["columns"] + column).cast("int")
            tx, ty = column * g["tile_width"], row * g["tile_height"]
            ax, ay = F.greatest(tx, left), F.greatest(ty, top)
            return F.struct(no.alias("no"), F.get(g["tile_ids"], no).alias("tile_id"), F.get(g["tile_no"], no).alias("node"), (ax - tx).alias("source_x"), (ay - ty).alias("source_y"), (ax - left).alias("target_x"), (ay - top).alias("target_y"), (F.least(tx + g["tile_width"], right) - ax).alias("width"), (F.least(ty + g["tile_height"], bottom) - ay).alias("height"), F.lit(None).cast("string").alias("error"))

        # the rows and columns of tiles that the region touches
        span = lambda lo, hi, size: F.sequence(div(lo, size), div(hi - 1, size))
        hit = F.flatten(F.transform(span(top, bottom, g["tile_height"]), lambda r: F.transform(span(left, right, g["tile_width"]), lambda k: tile(r, k))))
        none = F.array(F.struct(F.lit(None).cast("int").alias("no"), F.lit(None).cast("bigint").alias("tile_id"), F.lit(None).cast("int").alias("node"), *[F.lit(None).cast("bigint").alias(k) for k in ("source_x", "source_y", "target_x", "target_y", "width", "height")], g["error"].alias("error")))
        return F.when(g["error"].isNotNull(), none).when((right > left) & (bottom > top) & (g["tile_width"] > 0) & (g["tile_height"] > 0), hit).otherwise(F.slice(none, 1, 0))

    data = lambda t: let(node_payload(F.get(F.col("nodes"), t["node"])), lambda p: p["payload"])
    found = F.flatten(F.transform("grids", lambda g: F.transform(of(g), lambda t: F.struct(g["item_id"].alias("item_id"), t.alias("t"), *([data(t).alias("payload")] if payloads else [])))))
    columns = ["no", "tile_id", "source_x", "source_y", "target_x", "target_y", "width", "height", "error"]
    rows = grids(c).select("file_id", F.explode(found).alias("r"))
    return rows.select("file_id", "r.item_id", *[F.col(f"r.t.{k}").alias(k) for k in columns], *(["r.payload"] if payloads else []))
