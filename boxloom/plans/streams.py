"""HEVC streams as rows: parameter sets of items and slices of payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.functions.hevc_bits import PPS, SPS, picture_parameters, sequence_parameters, slice_start
from boxloom.operators.metrics import length_prefixed
from boxloom.plans.items import last_of, node_payload, properties
from boxloom.sources.boxes import Damaged, Short
from boxloom.sources.tables import Container

CODED = "width int, height int, coded_width int, coded_height int, crop_left int, crop_top int, bit_depth int, bit_depth_chroma int, chroma_format int, profile int, level int, full_range boolean, primaries int, transfer int, matrix int, ctb int, tile_columns int, tile_rows int, slices int, slice_types string, error string"


def describe(nals: list[bytes], payload: bytes | None, size: int) -> dict:
    """What an item's parameter sets and the slices of its payload say; later sets of a number replace earlier ones."""
    sps: dict[int, dict] = {}
    pps: dict[int, dict] = {}
    out: dict = {"slices": 0, "slice_types": ""}
    try:
        for n in [*nals, *(length_prefixed(payload, size) if payload else [])]:
            kind = n[0] >> 1 & 63 if n else 63
            if kind == SPS:
                s = sequence_parameters(n)
                sps[s["sps_id"]] = s
            elif kind == PPS:
                p = picture_parameters(n)
                pps[p["pps_id"]] = p
            elif kind < 32:
                s = slice_start(n, sps, pps)
                out["slices"] += 1
                out["slice_types"] += s.get("slice_type", "-")
        if not sps:
            raise Damaged("no sequence parameter set")
        out |= next(iter(sps.values()))
        out |= {k: v for k, v in next(iter(pps.values()), {}).items() if k.startswith("tile_")}
    except (Short, Damaged) as e:
        out["error"] = str(e) or "the stream ends early"
    return out


def coded_items(c: Container) -> DataFrame:
    """(file_id, item_id, ...): what the streams of HEVC items say of their pictures."""
    kind = c.parsed.schema["file_id"].dataType
    schema = T.StructType([T.StructField("file_id", kind), T.StructField("item_id", T.LongType()), *T.StructType.fromDDL(CODED).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, i, nals, size, payload in zip(*(x.to_pylist() for x in b.columns), strict=True):
                got = describe(nals or [], payload, size)
                rows.append({"file_id": f, "item_id": i} | {n: got.get(n) for n in schema.names[2:]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    coded = F.filter("nodes", lambda n: F.exists(properties(n["props"]), lambda p: p["kind"] == "hvcc"))
    items = c.whole.select("file_id", F.explode(F.transform(coded, lambda n: F.struct(n["item_id"].alias("item_id"), last_of(properties(n["props"]), "hvcc").alias("hvcc"), node_payload(n)["payload"].alias("payload")))).alias("r"))
    return items.select("file_id", "r.item_id", F.col("r.hvcc.nals").alias("nals"), F.col("r.hvcc.nal_length").alias("size"), "r.payload").mapInArrow(run, schema)
