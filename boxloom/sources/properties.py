"""Item properties: one function for each box type, returning the member of the property row; None where the box is damaged."""

from __future__ import annotations

from boxloom.sources.boxes import Bits, Damaged, Fields, Short

MOST_ICC = 4 << 20


def ispe(b: bytes) -> dict | None:
    f = Fields(b, 4)
    width, height = f.u(4), f.u(4)
    return {"width": width, "height": height} if width and height else None


def clap(b: bytes) -> dict | None:
    f = Fields(b)
    out = {}
    for name in ("width", "height", "horiz_off", "vert_off"):
        out[f"{name}_n"] = f.s(4) if "off" in name else f.u(4)
        out[f"{name}_d"] = f.u(4)
    return out if all(v for k, v in out.items() if k.endswith("_d")) else None


def irot(b: bytes) -> dict:
    """Degrees clockwise; the box counts quarter turns the other way."""
    return {"angle": (360 - 90 * (Fields(b).u(1) & 3)) % 360}


def imir(b: bytes) -> dict:
    return {"axis": Fields(b).u(1) & 1}


def colr(b: bytes) -> dict | None:
    f = Fields(b)
    kind = f.code()
    if kind == "nclx":
        return {"kind": "nclx", "primaries": f.u(2), "transfer": f.u(2), "matrix": f.u(2), "full_range": bool(f.u(1) >> 7), "icc": None}
    if kind in ("prof", "ricc", "rICC") and f.left <= MOST_ICC:
        return {"kind": "icc", "primaries": None, "transfer": None, "matrix": None, "full_range": None, "icc": f.take(f.left)}
    return None


def auxc(b: bytes) -> dict | None:
    if len(b) < 5:
        return None
    f = Fields(b, 4)
    return {"aux_type": f.text(), "subtype": f.take(f.left)}


def hvcc(b: bytes) -> dict | None:
    f = Fields(b)
    f.u(1)
    profile, compatible, constraints, level = f.u(1), f.u(4), f.u(6), f.u(1)
    f.u(2), f.u(1)
    chroma, luma_depth, chroma_depth = f.u(1) & 3, 8 + (f.u(1) & 7), 8 + (f.u(1) & 7)
    f.u(2)
    length, arrays = (f.u(1) & 3) + 1, f.u(1)
    if length == 3:
        return None
    nals: list[bytes] = []
    try:  # lists that end early are kept as far as they go
        for _ in range(arrays):
            f.u(1)
            for _ in range(f.u(2)):
                nals.append(f.take(f.u(2)))
    except Short:
        pass
    return {"profile_space": profile >> 6, "tier": profile >> 5 & 1, "profile": profile & 31, "compatible": compatible, "constraints": constraints, "level": level, "chroma_format": chroma, "bit_depth": luma_depth, "bit_depth_chroma": chroma_depth, "nal_length": length, "nals": nals}


def av1c(b: bytes) -> dict:
    f = Fields(b)
    f.u(1)
    bits = Bits(f.take(2))
    profile, level, _, high, twelve, mono, sub_x, sub_y = (bits.u(n) for n in (3, 5, 1, 1, 1, 1, 1, 1))
    f.u(1)
    return {"profile": profile, "level": level, "bit_depth": (12 if twelve else 10) if high else 8, "monochrome": bool(mono), "subsampling_x": sub_x, "subsampling_y": sub_y, "config": f.take(f.left)}


def uncc(b: bytes) -> dict | None:
    f = Fields(b, 4)
    profile, n = f.code(), f.u(4)
    if not 0 < n <= 16:
        return None
    parts = [{"index": f.u(2), "bit_depth": f.u(1) + 1, "format": f.u(1), "align": f.u(1)} for _ in range(n)]
    out = {"profile": profile, "components": parts, "sampling": 0, "interleave": 0, "block_size": 0, "components_le": False, "pad_lsb": False, "block_le": False, "reversed": False, "pad_unknown": False, "pixel_size": 0, "row_align": 0, "tile_align": 0, "tile_cols": 1, "tile_rows": 1}
    if f.left >= 4:
        out |= {"sampling": f.u(1), "interleave": f.u(1), "block_size": f.u(1)}
        flags = f.u(1)
        out |= {k: bool(flags >> bit & 1) for k, bit in (("components_le", 7), ("pad_lsb", 6), ("block_le", 5), ("reversed", 4), ("pad_unknown", 3))}
    for name, more in (("pixel_size", 0), ("row_align", 0), ("tile_align", 0), ("tile_cols", 1), ("tile_rows", 1)):
        if f.left >= 4:
            out[name] = f.u(4) + more
    return out


def cmpc(b: bytes) -> dict | None:
    f = Fields(b, 4)
    kind, unit = f.code(), f.u(1)
    return {"type": kind, "unit": unit} if unit <= 4 else None


def cmpd(b: bytes) -> list[int] | None:
    f = Fields(b)
    n = f.u(4)
    if not 0 < n <= 16:
        return None
    out = []
    for _ in range(n):
        out.append(f.u(2))
        if out[-1] >= 0x8000:
            f.text(len(b))
    return out


#: Widths of the fields of icef by their codes.
OFFSET_BITS, SIZE_BITS = (0, 16, 24, 32, 64), (8, 16, 24, 32, 64)


def icef(b: bytes) -> list[dict] | None:
    f = Fields(b, 4)
    codes, n = f.u(1), f.u(4)
    offset, size = codes >> 5, codes >> 2 & 7
    if offset > 4 or size > 4 or n > 1_000_000:
        return None
    out, at = [], 0
    for _ in range(n):
        begin = f.u(OFFSET_BITS[offset] // 8) if offset else at
        long = f.u(SIZE_BITS[size] // 8)
        out.append({"offset": begin, "size": long})
        at += long
    return out


PARSERS = {"ispe": ispe, "clap": clap, "irot": irot, "imir": imir, "colr": colr, "auxC": auxc, "hvcC": hvcc, "hvcB": hvcc, "av1C": av1c, "uncC": uncc, "cmpC": cmpc, "cmpd": cmpd, "icef": icef}
MEMBERS = {"ispe": "ispe", "clap": "clap", "irot": "irot", "imir": "imir", "colr": "colr", "auxC": "auxc", "hvcC": "hvcc", "hvcB": "hvcc", "av1C": "av1c", "uncC": "uncc", "cmpC": "cmpc", "cmpd": "cmpd", "icef": "icef"}


def parse_property(kind: str, content: bytes) -> dict:
    """A property row: its kind and the member of that name; a box that is unknown or damaged has the kind unknown."""
    try:
        got = PARSERS[kind](content) if kind in PARSERS else None
    except (Short, Damaged):
        got = None
    return {"kind": "unknown"} if got is None else {"kind": MEMBERS[kind], MEMBERS[kind]: got}
