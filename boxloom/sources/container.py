"""Parses a file of the HEIF family into rows: brands, items, extents, properties, associations, references, tracks."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from boxloom.sources.boxes import Bits, Box, Damaged, Fields, Short, boxes
from boxloom.sources.properties import MOST_ICC, PARSERS, parse_property

#: Brands of still images and sequences, and limits of the tables.
BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "mif2", "mif3", "avif", "avis")
MOST_ITEMS, MOST_EXTENTS, MOST_TARGETS, MOST_BRANDS, MOST_TRACKS = 65_536, 1_024, 4_096, 256, 16
#: Names of alpha planes.
ALPHA_URN, ALPHA_HEVC, ALPHA_AVC = "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", "urn:mpeg:hevc:2015:auxid:1", "urn:mpeg:avc:2015:auxid:1"


class Limits:
    """What a file may ask for; memory is the number of bytes that decoding one file may hold at once."""

    def __init__(self, width: int = 16_384, height: int = 16_384, pixels: int = 256_000_000, memory: int = 1 << 30):
        self.width, self.height, self.pixels, self.memory = width, height, pixels, memory

    def allow(self, width: int, height: int) -> bool:
        return 0 < width <= self.width and 0 < height <= self.height and width * height <= self.pixels


def empty() -> dict:
    return {"brand": None, "minor": None, "brands": [], "primary_id": None, "idat_off": None, "idat_len": None, "mdat_off": None, "mdat_len": None, "has_meta": False, "items": [], "extents": [], "props": [], "assocs": [], "refs": [], "tracks": [], "movie_timescale": None, "movie_duration": None, "warnings": []}


def read_ftyp(b: Box, out: dict) -> None:
    f = Fields(b.content)
    try:
        out["brand"], out["minor"] = f.code(), f.code()
    except Short:
        raise Damaged("ftyp is too short") from None
    out["brands"] = [f.code() for _ in range(min(f.left // 4, MOST_BRANDS))]
    if not {out["brand"], *out["brands"]} & set(BRANDS):
        raise Damaged("no brand of the HEIF family")


def read_pitm(b: Box, out: dict) -> None:
    f = Fields(b.content)
    version, _ = f.full()
    out["primary_id"] = f.u(4 if version else 2)


def read_iloc(b: Box, out: dict) -> None:
    f = Fields(b.content)
    version, _ = f.full()
    sizes = f.u(2)
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version >= 2 else 2
    if (n := f.u(wide)) > MOST_ITEMS:
        raise Damaged("too many locations")

    def number(size: int) -> int:
        return f.u(size) if size <= f.left else 0

    rows: list[dict] = []
    try:
        for i in range(n):
            item, method = f.u(wide), 0
            if version:
                method = f.u(2) & 15
            f.u(2)
            start = number(base)
            if (many := f.u(2)) > MOST_EXTENTS:
                raise Damaged("too many extents")
            mine = []
            for e in range(many):
                number(index)
                mine.append({"loc_ord": i, "item_id": item, "method": method, "base_offset": start, "ext_no": e, "offset": number(offset), "length": number(length)})
            rows += mine or [{"loc_ord": i, "item_id": item, "method": method, "base_offset": start, "ext_no": None, "offset": None, "length": None}]
    except Short:  # what stands before is kept
        pass
    out["extents"] = rows


def read_infe(b: bytes) -> dict | None:
    f = Fields(b)
    try:
        version, flags = f.full()
        item = f.u(4 if version >= 3 else 2)
        f.u(2)
        if len(b) < 8:
            return None
        kind = f.code() if version >= 2 else None
        return {"item_id": item, "item_type": kind, "name": f.text(), "content_type": f.text(), "hidden": bool(flags & 1)}
    except (Short, Damaged):
        return None


def read_iinf(b: Box, out: dict) -> None:
    f = Fields(b.content)
    version, _ = f.full()
    if (n := f.u(4 if version else 2)) > MOST_ITEMS:
        raise Damaged("too many items")
    found = [r for x in boxes(b.content[f.at :]) if x.type == "infe" and (r := read_infe(x.content))]
    out["items"] = [r | {"ord": i} for i, r in enumerate(found[:n])]


def read_ipma(b: Box, out: dict) -> None:
    f = Fields(b.content)
    version, flags = f.full()
    if (n := f.u(4)) > MOST_ITEMS:
        raise Damaged("too many associations")
    rows: list[dict] = []
    try:
        for i in range(n):
            item, many = f.u(4 if version else 2), f.u(1)
            rows.append({"assoc_ord": i, "item_id": item, "pos": None, "prop_idx": None, "essential": None})
            for k in range(many):
                wide = 2 if flags & 1 else 1
                if f.left < wide:
                    break
                x, top = f.u(wide), 8 * wide - 1
                row = {"assoc_ord": i, "item_id": item, "pos": k, "prop_idx": x & (1 << top) - 1, "essential": bool(x >> top)}
                if k:
                    rows.append(row)
                else:
                    rows[-1] = row
    except Short:
        pass
    out["assocs"] = rows


def read_iprp(b: Box, out: dict) -> None:
    for x in boxes(b.content):
        if x.type == "ipco":
            got = [parse_property(p.type, p.content) for p in boxes(x.content)]
            if len(got) > MOST_ITEMS:
                raise Damaged("too many properties")
            out["props"] = [p | {"prop_idx": i + 1} for i, p in enumerate(got)]
        elif x.type == "ipma":
            read_ipma(x, out)


def read_iref(b: Box, out: dict) -> None:
    version, _ = Fields(b.content).full()
    wide, rows, n = 4 if version else 2, [], 0
    for x in boxes(b.content[4:]):
        f = Fields(x.content)
        try:
            while f.left:
                if n >= MOST_ITEMS:
                    raise Damaged("too many references")
                source, many = f.u(wide), f.u(2)
                if many > MOST_TARGETS:
                    raise Damaged("too many targets")
                for k in range(min(many, f.left // wide)):
                    rows.append({"ref_ord": n, "ref_type": x.type, "from_id": source, "pos": k, "to_id": f.u(wide)})
                n += 1
        except Short:
            pass
    out["refs"] = rows


READERS = {"pitm": read_pitm, "iloc": read_iloc, "iinf": read_iinf, "iprp": read_iprp, "iref": read_iref}


def read_meta(b: Box, out: dict) -> None:
    if len(b.content) < 4:
        raise Damaged("meta is too short")
    for x in boxes(b.content[4:], b.offset + 4):
        try:
            if x.type in READERS:
                READERS[x.type](x, out)
            elif x.type == "idat":
                out["idat_off"], out["idat_len"] = x.offset, len(x.content)
        except Short:
            raise Damaged(f"{x.type} is too short") from None
    out["has_meta"] = True


#: Clockwise rotation and mirror axis for each orientation of a compact image.
ORIENTATIONS = {1: (0, None), 2: (0, 1), 3: (180, None), 4: (0, 0), 5: (90, 1), 6: (90, None), 7: (90, 0), 8: (270, None)}


def read_mini(b: Box, out: dict, limits: Limits) -> None:
    """A compact image: its bits become items 1 (image), 2 (alpha), 6 (Exif) and 7 (XMP) with their properties."""
    bits = Bits(b.content)
    version, own_codec, is_float, full, alpha, own_cicp, hdr, icc, exif, xmp = (bits.u(n) for n in (2, 1, 1, 1, 1, 1, 1, 1, 1, 1))
    chroma, orientation, large = bits.u(2), bits.u(3) + 1, bits.u(1)
    mark = bits.at
    width, height = (bits.u(15 if large else 7) + 1 for _ in range(2))
    old = bool(large and {width, height} & {32_767, 32_768})  # drafts had the flags of large fields the other way round
    if old:
        bits.at, large = mark, 0
        width, height = bits.u(7) + 1, bits.u(7) + 1
    if version or is_float or hdr:
        raise Damaged("mini: version, float samples or gain map aren't supported")
    if not limits.allow(width, height):
        raise Damaged("mini: the image is too large")
    if chroma in (1, 2):
        bits.u(1)
    if chroma == 1:
        bits.u(1)
    if bits.u(1):
        bits.u(3)
    if alpha:
        bits.u(1)
    if own_cicp:
        primaries, transfer, matrix = bits.u(8), bits.u(8), bits.u(8)
    else:
        primaries, transfer, matrix = 2 if icc else 1, 2 if icc else 13, 2 if chroma == 0 else 6
    fourcc = lambda: bits.u(32).to_bytes(4, "big").decode("latin-1")
    if own_codec:
        kind, config = fourcc(), fourcc()
    else:
        kind, config = {"heic": ("hvc1", "hvcC"), "heix": ("hvc1", "hvcC"), "avif": ("av01", "av1C"), "avis": ("av01", "av1C")}.get(out["minor"], (out["minor"], None))
    if kind not in ("hvc1", "av01") or config not in ("hvcC", "av1C"):
        raise Damaged("mini: the codec isn't supported")
    config = "hvcC" if kind == "hvc1" else "av1C"
    flip = lambda x: x ^ old
    large_meta = flip(bits.u(1)) if icc or exif or xmp else old
    large_config, large_data = flip(bits.u(1)), flip(bits.u(1))
    meta_bits, config_bits, data_bits = 20 if large_meta else 10, 12 if large_config else 3, 28 if large_data else 15
    icc_size = bits.u(meta_bits) + 1 if icc else 0
    main_config, main_size = bits.u(config_bits), bits.u(data_bits) + 1
    alpha_size = bits.u(data_bits) if alpha else 0
    alpha_config = bits.u(config_bits) if alpha_size else 0
    packed = bits.u(1) if exif or xmp else 0
    exif_size = bits.u(meta_bits) + 1 if exif else 0
    xmp_size = bits.u(meta_bits) + 1 if xmp else 0
    at, spans = (bits.at + 7) // 8, {}
    for name, size in (("config", main_config), ("alpha_config", alpha_config), ("icc", icc_size), ("alpha", alpha_size), ("main", main_size), ("exif", exif_size), ("xmp", xmp_size)):
        spans[name] = (at, size)
        at += size
    if at > len(b.content) or icc_size > MOST_ICC:
        raise Damaged("mini: the data end too early")
    if packed:
        out["warnings"].append("mini: compressed Exif and XMP aren't exposed")
        exif = xmp = 0
    part = lambda name: b.content[spans[name][0] : sum(spans[name])]
    items, extents, props, refs = [], [], [], []
    chosen: dict[int, list[int]] = {1: []}

    def item(n: int, kind: str, data: str, content_type: str = "", hidden: bool = False) -> None:
        items.append({"ord": len(items), "item_id": n, "item_type": kind, "name": "", "content_type": content_type, "hidden": hidden})
        extents.append({"loc_ord": len(extents), "item_id": n, "method": 0, "base_offset": 0, "ext_no": 0, "offset": b.offset + spans[data][0], "length": spans[data][1]})

    def prop(row: dict, *of: int) -> int:
        props.append(row | {"prop_idx": len(props) + 1})
        for n in of:
            chosen[n].append(len(props))
        return len(props)

    def codec(data: bytes, of: int) -> None:
        row = parse_property(config, data)
        if row["kind"] == "unknown":
            raise Damaged("mini: the codec's configuration is damaged")
        prop(row, of)

    item(1, kind, "main")
    codec(part("config"), 1)
    size = prop({"kind": "ispe", "ispe": {"width": width, "height": height}}, 1)
    if icc:
        prop({"kind": "colr", "colr": {"kind": "icc", "primaries": None, "transfer": None, "matrix": None, "full_range": None, "icc": part("icc")}}, 1)
    prop({"kind": "colr", "colr": {"kind": "nclx", "primaries": primaries, "transfer": transfer, "matrix": matrix, "full_range": bool(full), "icc": None}}, 1)
    both = (1,)
    if alpha_size:
        both, chosen[2] = (1, 2), []
        item(2, kind, "alpha", hidden=True)
        codec(part("alpha_config" if alpha_config else "config"), 2)
        chosen[2].append(size)
        prop({"kind": "auxc", "auxc": {"aux_type": ALPHA_URN, "subtype": b""}}, 2)
        refs.append({"ref_ord": len(refs), "ref_type": "auxl", "from_id": 2, "pos": 0, "to_id": 1})
    angle, axis = ORIENTATIONS[orientation]
    if angle:
        prop({"kind": "irot", "irot": {"angle": angle}}, *both)
    if axis is not None:
        prop({"kind": "imir", "imir": {"axis": axis}}, *both)
    for there, n, kind_, data, ct in ((exif, 6, "Exif", "exif", ""), (xmp, 7, "mime", "xmp", "application/rdf+xml")):
        if there:
            item(n, kind_, data, ct)
            refs.append({"ref_ord": len(refs), "ref_type": "cdsc", "from_id": n, "pos": 0, "to_id": 1})
    out |= {"items": items, "extents": extents, "props": props, "refs": refs, "primary_id": 1, "has_meta": True}
    out["assocs"] = [{"assoc_ord": i, "item_id": n, "pos": k, "prop_idx": p, "essential": True} for i, (n, mine) in enumerate(sorted(chosen.items())) for k, p in enumerate(mine)]


def times(b: bytes) -> tuple[int, int]:
    """Timescale and duration of mvhd or mdhd."""
    f = Fields(b)
    version, _ = f.full()
    if version > 1:
        raise Damaged("a header of unknown version")
    wide = 8 if version else 4
    f.take(2 * wide)
    scale, duration = f.u(4), f.u(wide)
    if not scale:
        raise Damaged("a timescale of zero")
    return scale, duration


def _table(b: bytes, fields: tuple, least: int = 1) -> list[tuple]:
    """The rows of a sample table; fields are functions of a cursor."""
    f = Fields(b)
    f.full()
    n = f.u(4)
    if not least <= n <= MOST_ITEMS:
        raise Damaged("a sample table is empty or too long")
    return [tuple(read(f) for read in fields) for _ in range(n)]


_U4, _U8, _S4 = (lambda f: f.u(4)), (lambda f: f.u(8)), (lambda f: f.s(4))


def read_stbl(b: bytes, t: dict) -> None:
    for x in boxes(b):
        name = {"co64": "stco"}.get(x.type, x.type)
        if name in t["_seen"]:
            raise Damaged(f"a second {x.type}")
        if x.type == "stsd":
            read_stsd(x.content, t)
            continue
        if x.type == "stsz":
            f = Fields(x.content)
            f.full()
            size, n = f.u(4), f.u(4)
            if not 0 < n <= MOST_ITEMS:
                raise Damaged("stsz is empty or too long")
            t["sizes"] = [size] * n if size else [f.u(4) for _ in range(n)]
        elif name == "stco":
            t["chunk_offsets"] = [r[0] for r in _table(x.content, (_U8 if x.type == "co64" else _U4,))]
        elif x.type == "stsc":
            t["stsc"] = [{"first_chunk": a, "per_chunk": n, "description": d} for a, n, d in _table(x.content, (_U4, _U4, _U4))]
        elif x.type == "stss":
            t["sync"] = [r[0] for r in _table(x.content, (_U4,), 0)]
            if not t["sync"]:
                continue
        elif x.type == "stts":
            t["stts"] = [{"count": n, "delta": d} for n, d in _table(x.content, (_U4, _U4))]
            if x.content[0] or not all(r["count"] and r["delta"] for r in t["stts"]):
                raise Damaged("stts has an empty run")
        elif x.type == "ctts":
            if x.content[:1] > b"\1":
                raise Damaged("ctts has an unknown version")
            t["ctts"] = [{"count": n, "offset": d} for n, d in _table(x.content, (_U4, _S4 if x.content[0] else _U4))]
            if not all(r["count"] for r in t["ctts"]):
                raise Damaged("ctts has an empty run")
        else:
            continue
        t["_seen"].add(name)


def read_stsd(b: bytes, t: dict) -> None:
    f = Fields(b)
    f.full()
    for _ in range(min(f.u(4), 16)):
        at, size, kind = f.at, f.u(4), f.code()
        if size < 8 or size > len(b) - at:
            raise Damaged("a sample description is damaged")
        entry = b[at : at + size]
        f.at = at + size
        if kind not in ("hvc1", "hev1", "av01"):
            continue
        g = Fields(entry, 32)
        width, height = g.u(2), g.u(2)
        if len(entry) < 86:
            raise Damaged("a sample description is too short")
        t["width"], t["height"] = t["width"] or width, t["height"] or height
        for x in boxes(entry[86:]):
            row = parse_property(x.type, x.content) if x.type in PARSERS else None
            if x.type in ("hvcC", "av1C") and t[x.type.lower()] is None:
                if row["kind"] == "unknown":
                    raise Damaged("a codec's configuration is damaged")
                t[x.type.lower()] = row[row["kind"]]
            elif x.type == "colr" and t["colr"] is None:
                t["colr"] = row.get("colr")
            elif x.type == "auxi":
                if len(x.content) < 5 or x.content[0] or b"\0" not in x.content[4:]:
                    raise Damaged("auxi is damaged")
                t["is_alpha"] |= Fields(x.content, 4).text(len(x.content)) in (ALPHA_URN, ALPHA_HEVC, ALPHA_AVC)
        return


def read_elst(b: bytes, t: dict) -> None:
    version, flags = Fields(b).full()
    if version > 1 or t["edits"] is not None:
        raise Damaged("elst has an unknown version, or is the second")
    wide = 8 if version else 4
    rows = _table(b, (lambda f: f.u(wide), lambda f: f.s(wide), lambda f: f.s(2), lambda f: f.s(2)))
    t["edits"] = [{"segment": a, "media_time": m, "rate": r, "rate_fraction": q} for a, m, r, q in rows]
    t["edit_repeat"] = bool(flags & 1)


def read_trak(b: bytes) -> dict:
    t: dict = {"track_id": None, "aux_for": None, "width": 0, "height": 0, "handler": None, "timescale": None, "media_duration": None, "hvcc": None, "av1c": None, "colr": None, "is_alpha": False, "sizes": None, "chunk_offsets": None, "stsc": None, "sync": None, "stts": None, "ctts": None, "edits": None, "edit_repeat": False, "_seen": set()}
    for x in boxes(b):
        f = Fields(x.content)
        if x.type == "tkhd":
            version, _ = f.full()
            if version > 1:
                raise Damaged("tkhd has an unknown version")
            wide = 8 if version else 4
            f.take(2 * wide)
            t["track_id"] = f.u(4)
            f.take(4 + wide + 52)
            t["width"], t["height"] = f.u(4) >> 16, f.u(4) >> 16
        elif x.type == "edts":
            for e in boxes(x.content):
                if e.type == "elst":
                    read_elst(e.content, t)
                    break
        elif x.type == "tref":
            for r in boxes(x.content):
                if r.type == "auxl":
                    if t["aux_for"] or not r.content or len(r.content) % 4 or not (to := Fields(r.content).u(4)):
                        raise Damaged("tref is damaged")
                    t["aux_for"] = to
        elif x.type == "mdia":
            for m in boxes(x.content):
                if m.type == "hdlr":
                    t["handler"] = Fields(m.content, 8).code()
                elif m.type == "mdhd":
                    t["timescale"], t["media_duration"] = times(m.content)
                elif m.type == "minf":
                    for s in boxes(m.content):
                        if s.type == "stbl":
                            read_stbl(s.content, t)
    t.pop("_seen")
    return t


def with_sums(t: dict) -> dict:
    """The track, its tables with what stands before each of their rows: samples, ticks and bytes. So a sample is found by searching, and
    runs are unrolled each for itself."""
    for name, value in (("stts", "delta"), ("ctts", None)):
        first = ticks = 0
        for r in t[name] or ():
            r["first"] = first
            first += r["count"]
            if value:
                r["time"] = ticks
                ticks += r["count"] * r[value]
    chunks, first = len(t["chunk_offsets"] or ()), 0
    spans = t["stsc"] or []
    for r, follows in zip(spans, [*spans[1:], None], strict=False):
        stop = min(follows["first_chunk"], chunks + 1) if follows else chunks + 1
        r["chunks"], r["first_sample"] = max(stop - r["first_chunk"], 0) if r["first_chunk"] else 0, first
        first += r["chunks"] * r["per_chunk"]
    before = 0
    for e in t["edits"] or ():
        e["before"] = before
        before += e["segment"]
    t["size_sums"] = [0, *accumulate(t["sizes"])] if t["sizes"] is not None else None
    t["sync_sorted"] = sorted({s for s in t["sync"] or () if s > 0})
    return t


def read_moov(b: Box, out: dict) -> None:
    """All tracks that can be read; which of them are used is decided on the tables."""
    for x in boxes(b.content):
        if len(out["tracks"]) >= MOST_TRACKS:
            break
        if x.type == "mvhd":
            out["movie_timescale"], out["movie_duration"] = times(x.content)
        elif x.type == "trak":
            try:
                out["tracks"].append(with_sums(read_trak(x.content)) | {"track": len(out["tracks"])})
            except (Short, Damaged):
                out["warnings"].append("a track is damaged")


def by_item(out: dict) -> dict:
    """The rows of a file once more, by item: what belongs together in one place each, found by its number.

    nodes are the first rows of items, with the numbers of their properties and of the items that they are derived from; locations
    the first extents of each item; links the references from one item."""
    number, nodes = {}, []
    for r in out["items"]:
        if r["item_id"] not in number:
            number[r["item_id"]] = len(nodes)
            nodes.append(r | {"props": [], "dimg": [], "dimg_no": [], "loc": None})
    seen: dict[int, int] = {}
    for a in out["assocs"]:
        if seen.setdefault(a["item_id"], a["assoc_ord"]) == a["assoc_ord"] and a["prop_idx"] is not None and a["item_id"] in number:
            nodes[number[a["item_id"]]]["props"].append(a["prop_idx"])
    seen, locations = {}, []
    for e in out["extents"]:
        if e["item_id"] not in seen:
            if e["item_id"] in number:
                nodes[number[e["item_id"]]]["loc"] = len(locations)
            locations.append({"item_id": e["item_id"], "method": e["method"], "parts": []})
        if seen.setdefault(e["item_id"], e["loc_ord"]) == e["loc_ord"] and e["ext_no"] is not None:
            locations[-1]["parts"].append({"at": e["base_offset"] + e["offset"], "length": e["length"]})
    links: dict[tuple, dict] = {}
    for r in out["refs"]:
        key = r["ref_type"], r["from_id"]
        link = links.setdefault(key, {"ref_type": key[0], "from_id": key[1], "from_no": number.get(key[1]), "targets": []})
        link["targets"].append({k: r[k] for k in ("ref_ord", "pos", "to_id")})
        if key[0] == "dimg" and key[1] in number:
            node = nodes[number[key[1]]]
            node["dimg"].append(r["to_id"])
            node["dimg_no"].append(number.get(r["to_id"]))
    return {"nodes": nodes, "locations": locations, "links": list(links.values()), "primary_no": number.get(out["primary_id"])}


def parse(content: bytes, limits: Limits | None = None) -> dict:
    """The rows of one file; `error` tells why it can't be read, and then there are none."""
    return parse_boxes(boxes(content), len(content), limits)


def parse_boxes(found: Iterable[Box], size: int, limits: Limits | None = None) -> dict:
    """parse() of a file of some size by its boxes at the top; of those that hold no tables only the length is looked at."""
    limits, out, moov = limits or Limits(), empty(), None
    try:
        if size < 16:
            raise Damaged("the file is too short")
        for b in found:
            if b.type == "ftyp":
                read_ftyp(b, out)
            elif b.type == "meta" and not out["has_meta"]:
                read_meta(b, out)
            elif b.type == "mini" and not out["has_meta"]:
                read_mini(b, out, limits)
            elif b.type == "mdat":
                out["mdat_off"], out["mdat_len"] = b.offset, len(b.content)
            elif b.type == "moov" and moov is None:
                moov = b
        if out["brand"] is None:
            raise Damaged("no ftyp")
        if moov and (not out["has_meta"] or {"avis", "msf1"} & {out["brand"], *out["brands"]}):
            try:
                read_moov(moov, out)
            except (Short, Damaged) as e:
                if not out["has_meta"]:
                    raise
                out["warnings"].append(f"moov is ignored: {e or 'it ends early'}")
                out["tracks"] = []
        if not out["has_meta"] and not out["tracks"]:
            raise Damaged("no meta, mini or moov with an image")
    except (Short, Damaged) as e:
        return empty() | {"nodes": [], "locations": [], "links": [], "primary_no": None, "error": str(e) or "the data end too early"}
    return out | by_item(out) | {"error": None}
