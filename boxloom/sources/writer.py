"""Writes small files of the HEIF family: fixtures for tests and for the round trips of the registered queries."""

from __future__ import annotations

import struct
from collections.abc import Iterable


def box(kind: str, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I", 8 + len(body)) + kind.encode("latin-1") + body


def full(kind: str, version: int, flags: int, *content: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


def ftyp(major: str = "mif1", brands: Iterable[str] = ("mif1", "heic")) -> bytes:
    return box("ftyp", major.encode(), b"\0\0\0\0", *(b.encode() for b in brands))


def infe(item: int, kind: str, name: str = "", content_type: str | None = None, hidden: bool = False) -> bytes:
    return full("infe", 2, int(hidden), struct.pack(">HH", item, 0), kind.encode("latin-1"), name.encode() + b"\0", b"" if content_type is None else content_type.encode() + b"\0")


def ispe(width: int, height: int) -> bytes:
    return full("ispe", 0, 0, struct.pack(">II", width, height))


def irot(turns: int) -> bytes:
    return box("irot", bytes([turns]))


def imir(axis: int) -> bytes:
    return box("imir", bytes([axis]))


def clap(width: int, height: int, dx: tuple[int, int] = (0, 1), dy: tuple[int, int] = (0, 1)) -> bytes:
    return box("clap", struct.pack(">IIIIiIiI", width, 1, height, 1, *dx, *dy))


def nclx(primaries: int, transfer: int, matrix: int, full_range: bool) -> bytes:
    return box("colr", b"nclx", struct.pack(">HHHB", primaries, transfer, matrix, full_range << 7))


def icc(profile: bytes) -> bytes:
    return box("colr", b"prof", profile)


def auxc(urn: str) -> bytes:
    return full("auxC", 0, 0, urn.encode() + b"\0")


def hvcc(depth: int = 8, nals: Iterable[bytes] = (), chroma: int = 1) -> bytes:
    nals = list(nals)
    lists = b"".join(struct.pack(">BHH", n[0] >> 1 if n else 0, 1, len(n)) + n for n in nals)
    return box("hvcC", bytes([1, 1]) + bytes(4) + bytes(6) + bytes([90]) + bytes(3) + bytes([chroma, depth - 8, depth - 8]) + bytes(2) + bytes([3, len(nals)]) + lists)


def av1c(depth: int = 8) -> bytes:
    return box("av1C", bytes([0x81, 0, (depth > 8) << 6 | (depth > 10) << 5, 0]))


def cmpd(*types: int) -> bytes:
    return box("cmpd", struct.pack(">I", len(types)), *(struct.pack(">H", t) for t in types))


def uncc(depths: Iterable[int], interleave: int = 0, block_size: int = 0, flags: int = 0, pixel_size: int = 0, sampling: int = 0, row_align: int = 0, tile_align: int = 0, tiles: tuple[int, int] = (1, 1), aligns: Iterable[int] | None = None) -> bytes:
    depths = list(depths)
    aligns = list(aligns or [0] * len(depths))
    parts = b"".join(struct.pack(">HBBB", i, d - 1, 0, a) for i, (d, a) in enumerate(zip(depths, aligns, strict=True)))
    return full("uncC", 0, 0, bytes(4), struct.pack(">I", len(depths)), parts, bytes([sampling, interleave, block_size, flags]), struct.pack(">IIIII", pixel_size, row_align, tile_align, tiles[0] - 1, tiles[1] - 1))


def cmpc(kind: str, unit: int = 0) -> bytes:
    return full("cmpC", 0, 0, kind.encode(), bytes([unit]))


def icef(sizes: Iterable[int]) -> bytes:
    sizes = list(sizes)
    return full("icef", 0, 0, bytes([3 << 2]), struct.pack(">I", len(sizes)), *(struct.pack(">I", s) for s in sizes))


def still(items: list[dict], props: list[bytes], refs: Iterable[tuple[str, int, list[int]]] = (), primary: int = 1, brands: Iterable[str] = ("mif1", "heic"), major: str = "mif1") -> bytes:
    """A file with a meta box. An item is {id, type, name, content_type, hidden, props: [index from 1], parts: [bytes], idat: bool};
    its parts become extents, one behind the other with a byte between."""
    idat = b""
    rows: list[tuple[int, int, list[tuple[int, int]]]] = []
    data = b""
    for it in items:
        parts, where = [], 1 if it.get("idat") else 0
        for p in it.get("parts", []):
            if where:
                parts.append((len(idat), len(p)))
                idat += p + b"\xee"
            else:
                parts.append((len(data), len(p)))
                data += p + b"\xee"
        rows.append((it["id"], where, parts))

    def meta(start: int) -> bytes:
        loc = struct.pack(">BBH", 0x44, 0x00, len(rows))
        for item, where, parts in rows:
            loc += struct.pack(">HHHH", item, where, 0, len(parts))
            for at, n in parts:
                loc += struct.pack(">II", at + (0 if where else start), n)
        assoc = b"".join(struct.pack(">HB", it["id"], len(it.get("props", []))) + bytes(0x80 | p for p in it.get("props", [])) for it in items)
        return full(
            "meta", 0, 0,
            full("hdlr", 0, 0, bytes(4), b"pict", bytes(13)), full("pitm", 0, 0, struct.pack(">H", primary)), full("iloc", 1, 0, loc),
            full("iinf", 0, 0, struct.pack(">H", len(items)), *(infe(it["id"], it["type"], it.get("name", ""), it.get("content_type"), it.get("hidden", False)) for it in items)),
            box("iprp", box("ipco", *props), full("ipma", 0, 0, struct.pack(">I", len(items)), assoc)),
            full("iref", 0, 0, *(box(kind, struct.pack(">HH", a, len(to)), *(struct.pack(">H", t) for t in to)) for kind, a, to in refs)),
            box("idat", idat) if idat else b"",
        )

    head = ftyp(major, brands)
    start = len(head) + len(meta(0)) + 8
    return head + meta(start) + box("mdat", data)


def track(sizes: list[int], deltas: list[tuple[int, int]], offsets: list[int], chunks: list[tuple[int, int]], shifts: list[tuple[int, int]] | None = None, sync: list[int] | None = None, edits: list[tuple[int, int]] | None = None, loop: bool = False, timescale: int = 1000, width: int = 64, height: int = 64, track_id: int = 1, handler: str = "pict", alpha_of: int | None = None) -> bytes:
    """A trak box with the given tables; shifts are written as version 1."""
    entry = box("hvc1", bytes(24), struct.pack(">HH", width, height), bytes(50), hvcc(), full("auxi", 0, 0, b"urn:mpeg:hevc:2015:auxid:1\0") if alpha_of else b"")
    n = lambda rows: struct.pack(">I", len(rows))
    pairs = lambda rows, f: b"".join(struct.pack(f, *r) for r in rows)
    stbl = [full("stsd", 0, 0, struct.pack(">I", 1), entry), full("stsz", 0, 0, struct.pack(">I", 0), n(sizes), *(struct.pack(">I", s) for s in sizes)), full("stco", 0, 0, n(offsets), *(struct.pack(">I", o) for o in offsets)), full("stsc", 0, 0, n(chunks), *(struct.pack(">III", a, k, 1) for a, k in chunks)), full("stts", 0, 0, n(deltas), pairs(deltas, ">II"))]
    if shifts:
        stbl.append(full("ctts", 1, 0, n(shifts), pairs(shifts, ">Ii")))
    if sync is not None:
        stbl.append(full("stss", 0, 0, n(sync), *(struct.pack(">I", s) for s in sync)))
    tkhd = full("tkhd", 0, 7, bytes(8), struct.pack(">I", track_id), bytes(4 + 4 + 52), struct.pack(">II", width << 16, height << 16))
    mdhd = full("mdhd", 0, 0, bytes(8), struct.pack(">II", timescale, sum(a * b for a, b in deltas)), bytes(4))
    hdlr = full("hdlr", 0, 0, bytes(4), handler.encode(), bytes(13))
    edts = box("edts", full("elst", 0, int(loop), n(edits), *(struct.pack(">Iihh", seg, at, 1, 0) for seg, at in edits))) if edits else b""
    tref = box("tref", box("auxl", struct.pack(">I", alpha_of))) if alpha_of else b""
    return box("trak", tkhd, edts, tref, box("mdia", mdhd, hdlr, box("minf", box("stbl", *stbl))))


def movie(tracks: list[bytes], timescale: int, duration: int, data: bytes = b"", wide: bool = False, brands: tuple[str, str] = ("msf1", "hevc")) -> bytes:
    """A sequence without a meta box. The data stand in front, so that chunk offsets can be told beforehand: they begin at 32."""
    head = ftyp(brands[0], brands)
    mvhd = full("mvhd", 1, 0, bytes(16), struct.pack(">IQ", timescale, duration)) if wide else full("mvhd", 0, 0, bytes(8), struct.pack(">II", timescale, duration))
    return head + box("mdat", data) + box("moov", mvhd, *tracks)


class BitWriter:
    def __init__(self) -> None:
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        self.bits.append(format(value, f"0{n}b"))

    def align(self) -> None:
        have = sum(map(len, self.bits))
        self.bits.append("0" * (-have % 8))

    def bytes(self) -> bytes:
        self.align()
        text = "".join(self.bits)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def pack_samples(planes: list[list[list[int]]], depths: list[int], interleave: int, tiles: tuple[int, int] = (1, 1)) -> bytes:
    """Samples (component, row, column) without alignment or blocks: planar 0, pixel 1, row 3, tile-planar 4."""
    out = bytearray()
    height, width = len(planes[0]), len(planes[0][0])
    tw, th = width // tiles[0], height // tiles[1]
    places = [(x, y) for y in range(0, height, th) for x in range(0, width, tw)]

    def rows(order: Iterable[tuple[int, int, list[int]]]) -> None:
        """Each element is a row: which components of which pixels."""
        for y, x0, parts in order:
            w = BitWriter()
            for x in range(x0, x0 + tw):
                for c in parts:
                    w.put(planes[c][y][x], depths[c])
            out.extend(w.bytes())

    every = range(len(planes))
    if interleave == 4:
        for c in every:
            for x0, y0 in places:
                rows((y, x0, [c]) for y in range(y0, y0 + th))
        return bytes(out)
    for x0, y0 in places:
        if interleave == 0:
            for c in every:
                rows((y, x0, [c]) for y in range(y0, y0 + th))
        elif interleave == 1:
            rows((y, x0, list(every)) for y in range(y0, y0 + th))
        else:
            rows((y, x0, [c]) for y in range(y0, y0 + th) for c in every)
    return bytes(out)


def unci_file(payload: bytes, width: int, height: int, layout: bytes, types: Iterable[int], more: Iterable[bytes] = (), extra: Iterable[dict] = (), extra_props: Iterable[bytes] = (), refs: Iterable[tuple[str, int, list[int]]] = ()) -> bytes:
    """A file whose primary item 1 is an uncompressed image; `more` are further properties of it, extra items come with their own."""
    props = [ispe(width, height), layout, cmpd(*types), *more]
    return still([{"id": 1, "type": "unci", "props": list(range(1, len(props) + 1)), "parts": [payload]}, *extra], [*props, *extra_props], refs, brands=("mif1", "heic", "unci"))


def mini(width: int, height: int, orientation: int = 1, exif: bytes = b"", xmp: bytes = b"", icc_profile: bytes = b"", alpha: bytes = b"", data: bytes = b"\1", codec: bytes | None = None, full_range: bool = True, cicp: tuple[int, int, int] | None = None) -> bytes:
    """A compact HEVC image: ftyp and mini."""
    w, config = BitWriter(), (codec or hvcc())[8:]
    for v, n in ((0, 2), (0, 1), (0, 1), (full_range, 1), (bool(alpha), 1), (cicp is not None, 1), (0, 1), (bool(icc_profile), 1), (bool(exif), 1), (bool(xmp), 1), (3, 2), (orientation - 1, 3), (1, 1), (width - 1, 15), (height - 1, 15), (0, 1)):
        w.put(int(v), n)
    if alpha:
        w.put(0, 1)
    for v in cicp or ():
        w.put(v, 8)
    if icc_profile or exif or xmp:
        w.put(1, 1)
    w.put(1, 1)
    w.put(1, 1)
    if icc_profile:
        w.put(len(icc_profile) - 1, 20)
    w.put(len(config), 12)
    w.put(len(data) - 1, 28)
    if alpha:
        w.put(len(alpha), 28)
        w.put(0, 12)
    if exif or xmp:
        w.put(0, 1)
    for part in (exif, xmp):
        if part:
            w.put(len(part) - 1, 20)
    return box("ftyp", b"mif3", b"heic", b"mif3", b"heic") + box("mini", w.bytes(), config, icc_profile, alpha, data, exif, xmp)


class HevcBits(BitWriter):
    """Bits of an HEVC unit."""

    def ue(self, v):
        n = (v + 1).bit_length()
        self.put(v + 1, 2 * n - 1)

    def se(self, v):
        self.ue(2 * v - 1 if v > 0 else -2 * v)

    def nal(self, kind, layer=0):
        self.put(1, 1)
        raw, out = bytes([kind << 1, layer + 1]) + self.bytes(), bytearray()
        for x in raw:  # escapes
            if x < 4 and len(out) > 1 and out[-1] == 0 and out[-2] == 0:
                out.append(3)
            out.append(x)
        return bytes(out)


def hevc_sps(width=64, height=48, crop=(0, 0, 0, 0), depth=8, sets=(), colour=None, chroma=1):
    """A sequence parameter set with blocks of 32, and the given reference sets: lists of differences before and after."""
    b = HevcBits()
    b.put(0, 4), b.put(0, 3), b.put(1, 1)
    b.put(1, 8), b.put(0x60000000, 32), b.put(0, 48), b.put(93, 8)
    b.ue(0), b.ue(chroma)
    if chroma == 3:
        b.put(0, 1)
    b.ue(width), b.ue(height), b.put(any(crop), 1)
    if any(crop):
        for v in crop:
            b.ue(v)
    b.ue(depth - 8), b.ue(depth - 8), b.ue(4)
    b.put(1, 1), b.ue(4), b.ue(2), b.ue(0)
    for v in (0, 2, 0, 3, 1, 1):
        b.ue(v)
    b.put(0, 1), b.put(1, 1), b.put(1, 1), b.put(0, 1)
    b.ue(len(sets))
    for i, (before, after) in enumerate(sets):
        if i:
            b.put(0, 1)
        b.ue(len(before)), b.ue(len(after))
        for way, ds in ((-1, before), (1, after)):
            at = 0
            for d in ds:
                b.ue(way * (d - at) - 1), b.put(1, 1)
                at = d
    b.put(0, 1), b.put(1, 1), b.put(1, 1)
    b.put(colour is not None, 1)
    if colour:
        b.put(0, 2), b.put(1, 1), b.put(5, 3), b.put(colour[0], 1), b.put(1, 1)
        for v in colour[1:]:
            b.put(v, 8)
    return b.nal(33)


def hevc_pps(tiles=None):
    """A picture parameter set with dependent slices."""
    b = HevcBits()
    b.ue(0), b.ue(0), b.put(1, 1), b.put(0, 1), b.put(0, 3), b.put(0, 2), b.ue(0), b.ue(0), b.se(-3), b.put(0, 2), b.put(0, 1), b.se(2), b.se(-1), b.put(0, 4), b.put(tiles is not None, 1), b.put(0, 1)
    if tiles:
        b.ue(tiles[0] - 1), b.ue(tiles[1] - 1)
    return b.nal(34)


def hevc_slice(kind, slice_type, poc=None, first=True, address=0, which=None, layer=0, dependent=False, address_bits=2):
    """The beginning of a slice; which is the number of its reference set, of two."""
    b = HevcBits()
    b.put(first, 1)
    if 16 <= kind <= 23:
        b.put(0, 1)
    b.ue(0)
    if not first:
        b.put(dependent, 1), b.put(address, address_bits)
    if not dependent:
        b.ue(slice_type)
        if kind not in (19, 20):
            b.put(poc, 8), b.put(1, 1)
            if which is not None:
                b.put(which, 1)
    return b.nal(kind, layer)
