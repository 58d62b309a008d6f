"""Uncompressed images: where each sample's bits stand is worked out for whole planes at once, then all are gathered.

Samples come out with 8 bits. Data that end early give zero bits, but are an error in block layouts."""

from __future__ import annotations

import functools
import zlib

import numpy as np

from boxloom.operators.frames import Frame

#: The plane of each component type (0 luma or green, 1 Cb or blue, 2 Cr or red, 3 alpha).
PLANES = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 0, 6: 1, 7: 3}
PLANAR, PIXEL, MIXED, ROW, TILE_PLANAR = 0, 1, 2, 3, 4


class Unsupported(ValueError):
    pass


def unpacked(kind: str, units: list[dict] | None, data: bytes, most: int = 1 << 30) -> bytes:
    """The payload behind its compression, unit by unit where there are several; no more than `most` bytes come out, whatever is packed."""
    windows = {"zlib": zlib.MAX_WBITS, "defl": -zlib.MAX_WBITS}
    if kind not in windows:
        raise Unsupported(f"compression {kind.strip()} is unsupported")
    spans = [(int(u["offset"]), int(u["size"])) for u in units] if units else [(0, len(data))]
    out = []
    for at, n in spans:
        if at + n > len(data):
            raise ValueError("a compressed unit leaves the payload")
        if most <= 0:
            break
        try:
            out.append(zlib.decompressobj(windows[kind]).decompress(data[at : at + n], most))
        except zlib.error as e:
            raise ValueError(f"a compressed unit is damaged: {e}") from None
        most -= len(out[-1])
    return b"".join(out)


def needed(uncc: dict, width: int, height: int) -> int:
    """At least as many bytes as the samples of an image take, with what aligns them."""
    cols, rows = max(uncc["tile_cols"], 1), max(uncc["tile_rows"], 1)
    tw, th = -(-width // cols), -(-height // rows)
    cells = [max(p["align"], uncc["block_size"], 2) for p in uncc["components"]]
    row = max(sum(_up(tw * n + 8, uncc["row_align"]) for n in cells), _up(tw * uncc["pixel_size"] + 8, uncc["row_align"]))
    return cols * rows * _up(th * row, uncc["tile_align"])


def to_8_bits(v: np.ndarray, depth: int) -> np.ndarray:
    if depth >= 8:
        return v >> (depth - 8) & 255
    most = (1 << depth) - 1
    return (v * 255 + most // 2) // most


def _up(n: int, unit: int) -> int:
    return -(-n // unit) * unit if unit else n


@functools.lru_cache(maxsize=32)
def _row(cells: tuple[tuple[int, int], ...], columns: int, pixel_size: int = 0) -> tuple[np.ndarray, int]:
    """Bit positions (columns, cells) within a row of repeated cells (depth, align bytes), and the row's bytes. Pictures of one
    layout share them, so they are read only."""
    if not pixel_size and (all(a == 0 for _, a in cells) or all(a and 8 * a >= d for d, a in cells)):
        step = np.array([8 * a if a else d for d, a in cells])
        lead = np.array([8 * a - d if a else 0 for d, a in cells])
        start = np.cumsum(step) - step
        out = np.arange(columns)[:, None] * step.sum() + (start + lead)[None, :]
        out.flags.writeable = False
        return out, -(-columns * int(step.sum()) // 8)
    out, at = np.zeros((columns, len(cells)), np.int64), 0
    for x in range(columns):
        begin = at // 8
        for i, (depth, align) in enumerate(cells):
            if align:
                at = _up(at, 8) + max(8 * align - depth, 0)
            out[x, i] = at
            at += depth
        if pixel_size:
            used = _up(at, 8) // 8 - begin
            if pixel_size < used:
                raise ValueError("the pixel size is too small")
            at = 8 * (begin + pixel_size)
    out.flags.writeable = False
    return out, -(-at // 8)


class _Gather:
    def __init__(self, data: bytes):
        self.size = len(data)
        self.data = np.frombuffer(data + bytes(4), np.uint8)

    def bits(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Numbers of up to 16 bits at bit positions; zero bits behind the end, where zero bytes stand."""
        byte, last = at >> 3, len(self.data) - 1
        if depth == 8 and not (at & 7).any():
            return self.data[np.minimum(byte, last)].astype(np.int64)
        word = np.zeros(at.shape, np.int64)
        for k in range(3):
            word = word << 8 | self.data[np.minimum(byte + k, last)]
        return word >> (24 - (at & 7) - depth) & (1 << depth) - 1

    def blocks(self, at: np.ndarray, size: int, little: bool) -> np.ndarray:
        """Blocks of `size` bytes at byte positions, as unsigned 64-bit numbers."""
        if at.size and int(at.max()) + size > self.size:
            raise ValueError("the blocks end early")
        word = np.zeros(at.shape, np.uint64)
        for k in range(size):
            word |= self.data[at + k].astype(np.uint64) << np.uint64(8 * (k if little else size - 1 - k))
        return word


def decode(uncc: dict, cmpc: dict | None, types: list[int] | None, icef: list[dict] | None, data: bytes, width: int, height: int, memory: int = 1 << 30, native: bool = False) -> Frame:
    """The frame of an uncompressed image; Unsupported or ValueError where there is none. With `native` its samples keep their depth, which
    has to be one for all components; else they have 8 bits."""
    parts, sampling, layout = uncc["components"], uncc["sampling"], uncc["interleave"]
    if sampling > 2 or layout > 4:
        raise Unsupported("the sampling or interleave type is unsupported")
    if layout == MIXED and not sampling or sampling and layout not in (PLANAR, MIXED, TILE_PLANAR):
        raise Unsupported("this interleave doesn't go with the sampling")
    if uncc["pixel_size"] and layout != PIXEL or uncc["block_size"] and layout not in (PLANAR, PIXEL):
        raise Unsupported("pixel or block sizes don't go with the interleave")
    if any(not 1 <= p["bit_depth"] <= 16 or p["format"] for p in parts):
        raise Unsupported("only unsigned components of 1 to 16 bits are supported")
    bits = parts[0]["bit_depth"] if native and parts else 8
    if native and any(p["bit_depth"] != bits for p in parts):
        raise Unsupported("components of several depths have no planes of one")
    fit = (lambda v, _: v) if native else to_8_bits
    kinds = [types[p["index"]] if types and p["index"] < len(types) else p["index"] for p in parts]
    planes, depths, aligns = [PLANES.get(k) for k in kinds], [p["bit_depth"] for p in parts], [p["align"] for p in parts]
    cols, rows = uncc["tile_cols"], uncc["tile_rows"]
    if width % cols or height % rows or not width // cols or not height // rows:
        raise ValueError("the tiles don't divide the image")
    tw, th = width // cols, height // rows
    kx, ky = 1 + (sampling > 0), 1 + (sampling == 2)
    if tw % kx or th % ky:
        raise ValueError("subsampled tiles need even sizes")
    if cmpc and needed(uncc, width, height) > memory:
        raise ValueError("the image needs more memory than allowed")
    source = _Gather(unpacked(cmpc["type"], icef, data, needed(uncc, width, height)) if cmpc else data)
    out = [np.zeros((height, width), np.uint16), *(np.zeros((height // ky, width // kx), np.uint16) for _ in range(2)), np.full((height, width), (1 << bits) - 1, np.uint16) if 7 in kinds else None]

    def put(plane: int | None, tx: int, ty: int, v: np.ndarray) -> None:
        if plane is not None:
            h, w = v.shape
            out[plane][ty * h : ty * h + h, tx * w : tx * w + w] = v

    size = lambda plane: (tw // kx, th // ky) if plane in (1, 2) else (tw, th)
    row_align, tile_align = uncc["row_align"], uncc["tile_align"]
    at = 0  # byte where the next rows begin
    if uncc["block_size"]:
        _blocks(uncc, planes, depths, source, put, cols, rows, tw, th, fit)
    elif layout == TILE_PLANAR:
        for plane, depth, align in zip(planes, depths, aligns, strict=True):
            w, h = size(plane)
            pos, n = _row(((depth, align),), w)
            n = _up(n, row_align)
            for t in range(cols * rows):
                put(plane, t % cols, t // cols, fit(source.bits(8 * (at + n * np.arange(h))[:, None] + pos[:, 0], depth), depth))
                at += _up(n * h, tile_align)
    else:
        for t in range(cols * rows):
            tx, ty, begin = t % cols, t // cols, at
            if layout == PIXEL:
                pos, n = _row(tuple(zip(depths, aligns, strict=True)), tw, uncc["pixel_size"])
                n = _up(n, row_align)
                for i, (plane, depth) in enumerate(zip(planes, depths, strict=True)):
                    put(plane, tx, ty, fit(source.bits(8 * (at + n * np.arange(th))[:, None] + pos[:, i], depth), depth))
                at += n * th
            elif layout == ROW:
                each = [_row((c,), tw) for c in zip(depths, aligns, strict=True)]
                sizes = [_up(n, row_align) for _, n in each]
                for i, (plane, depth) in enumerate(zip(planes, depths, strict=True)):
                    first = at + sum(sizes[:i])
                    put(plane, tx, ty, fit(source.bits(8 * (first + sum(sizes) * np.arange(th))[:, None] + each[i][0][:, 0], depth), depth))
                at += sum(sizes) * th
            else:
                paired = False
                for plane, depth, align in zip(planes, depths, aligns, strict=True):
                    w, h = size(plane)
                    if layout == MIXED and plane in (1, 2):
                        if paired:
                            continue
                        paired = True
                        pos, n = _row(((depth, 0), (depth, 0)), w)
                        for k, p in enumerate((plane, 3 - plane)):
                            put(p, tx, ty, fit(source.bits(8 * (at + n * np.arange(h))[:, None] + pos[:, k], depth), depth))
                    else:
                        pos, n = _row(((depth, align),), w)
                        n = _up(n, row_align)
                        put(plane, tx, ty, fit(source.bits(8 * (at + n * np.arange(h))[:, None] + pos[:, 0], depth), depth))
                    at += n * h
            at = begin + _up(at - begin, tile_align)
    rgb, yuv = any(4 <= k <= 6 for k in kinds), any(1 <= k <= 3 for k in kinds)
    if not rgb and not yuv and len(parts) == 1:
        out[1][...] = out[2][...] = 1 << bits - 1
    return Frame(*out, depth=bits, chroma_depth=bits, chroma={0: 3, 1: 2, 2: 1}[sampling], matrix=6 if not rgb and (yuv or len(parts) == 1) else 0, primaries=1, transfer=13)


def _blocks(uncc: dict, planes: list, depths: list[int], source: _Gather, put, cols: int, rows: int, tw: int, th: int, fit=to_8_bits) -> None:
    """Layouts of whole blocks, one for each sample or each pixel."""
    block, pixel, row_align, tile_align, little = uncc["block_size"], uncc["pixel_size"], uncc["row_align"], uncc["tile_align"], uncc["block_le"]
    if block > 8 or uncc["sampling"] or uncc["components_le"]:
        raise Unsupported("this block layout is unsupported")
    cut = lambda word, shift, depth: fit((word >> np.uint64(shift) & np.uint64((1 << depth) - 1)).astype(np.int64), depth)
    at = 0
    if uncc["interleave"] == PLANAR:
        if any(not 4 * block < d <= 8 * block for d in depths):
            raise Unsupported("a component's depth doesn't go with the block size")
        n = _up(tw * block, row_align)
        for t in range(cols * rows):
            begin = at
            for plane, depth in zip(planes, depths, strict=True):
                word = source.blocks((at + n * np.arange(th))[:, None] + block * np.arange(tw), block, little)
                put(plane, t % cols, t // cols, cut(word, 8 * block - depth if uncc["pad_lsb"] else 0, depth))
                at += n * th
            at = begin + _up(at - begin, tile_align)
        return
    if not pixel or pixel < block:
        raise Unsupported("the pixel size doesn't go with the block size")
    # from which bit of a block on each component stands: the last in the lowest bits, or the other way round
    order = range(len(depths)) if uncc["reversed"] else range(len(depths) - 1, -1, -1)
    shifts, low = {}, 0
    for i in order:
        shifts[i] = 8 * block - low - depths[i] if uncc["pad_lsb"] else low
        low += depths[i]
    if low > 8 * block:
        raise Unsupported("the components don't fit their block")
    n = _up(tw * pixel, row_align)
    for t in range(cols * rows):
        word = source.blocks((at + n * np.arange(th))[:, None] + pixel * np.arange(tw), block, little)
        for i, (plane, depth) in enumerate(zip(planes, depths, strict=True)):
            put(plane, t % cols, t // cols, cut(word, shifts[i], depth))
        at += _up(n * th, tile_align)
