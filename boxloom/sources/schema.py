"""Types of the rows that files are parsed into."""

from __future__ import annotations

_U64 = "decimal(20,0)"
COLR = "struct<kind: string, primaries: int, transfer: int, matrix: int, full_range: boolean, icc: binary>"
HVCC = "struct<profile_space: int, tier: int, profile: int, compatible: bigint, constraints: bigint, level: int, chroma_format: int, bit_depth: int, bit_depth_chroma: int, nal_length: int, nals: array<binary>>"
AV1C = "struct<profile: int, level: int, bit_depth: int, monochrome: boolean, subsampling_x: int, subsampling_y: int, config: binary>"
CLAP = "struct<width_n: bigint, width_d: bigint, height_n: bigint, height_d: bigint, horiz_off_n: bigint, horiz_off_d: bigint, vert_off_n: bigint, vert_off_d: bigint>"
UNCC = "struct<profile: string, components: array<struct<index: int, bit_depth: int, format: int, align: int>>, sampling: int, interleave: int, block_size: int, components_le: boolean, pad_lsb: boolean, block_le: boolean, reversed: boolean, pad_unknown: boolean, pixel_size: bigint, row_align: bigint, tile_align: bigint, tile_cols: bigint, tile_rows: bigint>"
MEMBERS = {
    "ispe": "struct<width: bigint, height: bigint>",
    "clap": CLAP,
    "irot": "struct<angle: int>",
    "imir": "struct<axis: int>",
    "colr": COLR,
    "auxc": "struct<aux_type: string, subtype: binary>",
    "hvcc": HVCC,
    "av1c": AV1C,
    "uncc": UNCC,
    "cmpc": "struct<type: string, unit: int>",
    "cmpd": "array<int>",
    "icef": f"array<struct<offset: {_U64}, size: {_U64}>>",
}
ROWS = {
    "items": "ord: int, item_id: bigint, item_type: string, name: string, content_type: string, hidden: boolean",
    "extents": f"loc_ord: int, item_id: bigint, method: int, base_offset: {_U64}, ext_no: int, offset: {_U64}, length: {_U64}",
    "props": "prop_idx: int, kind: string, " + ", ".join(f"{k}: {v}" for k, v in MEMBERS.items()),
    "assocs": "assoc_ord: int, item_id: bigint, pos: int, prop_idx: int, essential: boolean",
    "refs": "ref_ord: int, ref_type: string, from_id: bigint, pos: int, to_id: bigint",
    "tracks": f"track: int, track_id: bigint, aux_for: bigint, width: bigint, height: bigint, handler: string, timescale: bigint, media_duration: {_U64}, hvcc: {HVCC}, av1c: {AV1C}, colr: {COLR}, is_alpha: boolean, sizes: array<bigint>, chunk_offsets: array<{_U64}>, stsc: array<struct<first_chunk: bigint, per_chunk: bigint, description: bigint, chunks: bigint, first_sample: bigint>>, sync: array<bigint>, stts: array<struct<count: bigint, delta: bigint, first: bigint, time: decimal(38,0)>>, ctts: array<struct<count: bigint, offset: bigint, first: bigint>>, edits: array<struct<segment: {_U64}, media_time: bigint, rate: int, rate_fraction: int, before: decimal(38,0)>>, edit_repeat: boolean, size_sums: array<bigint>, sync_sorted: array<bigint>",
}
#: The same rows by item, for questions that are answered in the row of a file.
NESTED = {
    "nodes": "item_id: bigint, ord: int, item_type: string, name: string, content_type: string, hidden: boolean, props: array<int>, dimg: array<bigint>, dimg_no: array<int>, loc: int",
    "locations": "item_id: bigint, method: int, parts: array<struct<at: decimal(38,0), length: decimal(20,0)>>",
    "links": "ref_type: string, from_id: bigint, from_no: int, targets: array<struct<ref_ord: int, pos: int, to_id: bigint>>",
}
FILE = f"primary_no: int, has_meta: boolean, brand: string, minor: string, brands: array<string>, primary_id: bigint, idat_off: bigint, idat_len: bigint, mdat_off: bigint, mdat_len: bigint, movie_timescale: bigint, movie_duration: {_U64}, error: string, warnings: array<string>"
