"""Pictures as planes: crop, mirror, rotate, alpha, overlay, grid, and conversion to packed 8-bit pixels, in NumPy.

A frame is planes of 16-bit samples and a crop rectangle; samples of 0xFFFF were never written, and count as black or neutral."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from boxloom.functions.colour import FULL, LIMITED, LUMA

UNSET = 0xFFFF
#: Luma samples for one chroma sample, across and down, by chroma format.
STEPS = {0: (1, 1), 1: (2, 2), 2: (2, 1), 3: (1, 1)}


@dataclass
class Frame:
    y: np.ndarray
    cb: np.ndarray | None = None
    cr: np.ndarray | None = None
    a: np.ndarray | None = None
    depth: int = 8
    chroma_depth: int = 8
    chroma: int = 3
    full_range: bool = True
    matrix: int = 6
    primaries: int = 2
    transfer: int = 2
    crop: tuple[int, int, int, int] = field(default=(0, 0, 0, 0))  # left, right, top, bottom

    @property
    def width(self) -> int:
        return self.y.shape[1] - self.crop[0] - self.crop[1]

    @property
    def height(self) -> int:
        return self.y.shape[0] - self.crop[2] - self.crop[3]

    def planes(self, f) -> Frame:
        """The frame with f applied to each plane."""
        return replace(self, **{k: None if (p := getattr(self, k)) is None else f(p) for k in ("y", "cb", "cr", "a")})


def blank(width: int, height: int, depth: int = 8, chroma: int = 1, chroma_depth: int | None = None, fill: tuple[int, int, int] = (UNSET, UNSET, UNSET)) -> Frame:
    sx, sy = STEPS[chroma]
    small = (-(-height // sy), -(-width // sx))
    plane = lambda v: np.full(small, v, np.uint16) if chroma else None
    return Frame(np.full((height, width), fill[0], np.uint16), plane(fill[1]), plane(fill[2]), depth=depth, chroma_depth=chroma_depth or depth, chroma=chroma)


def half_away(x: float) -> int:
    """Rounded, halves away from zero."""
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def aperture(f: Frame, clap: dict) -> Frame:
    """The crop narrowed to a clean aperture; one larger than the picture is cut to it."""
    size = [min(clap[f"{k}_n"] // clap[f"{k}_d"], now) for k, now in (("width", f.width), ("height", f.height))]
    if 0 in size or size == [f.width, f.height]:
        return f
    out = []
    for new, now, k in ((size[0], f.width, "horiz_off"), (size[1], f.height, "vert_off")):
        before = min(max(half_away((now - new) / 2 + clap[f"{k}_n"] / clap[f"{k}_d"]), 0), now - new)
        out += [before, now - new - before]
    return replace(f, crop=tuple(a + b for a, b in zip(f.crop, out, strict=True)))


def mirror(f: Frame, axis: int) -> Frame:
    """Top for bottom (axis 0), or left for right (axis 1); alpha goes along."""
    left, right, top, bottom = f.crop
    if axis == 0:
        return replace(f.planes(lambda p: p[::-1]), crop=(left, right, bottom, top))
    return replace(f.planes(lambda p: p[:, ::-1]), crop=(right, left, top, bottom))


def rotate(f: Frame, angle: int) -> Frame:
    """Turned clockwise by 0, 90, 180 or 270 degrees; alpha goes along. Turned 4:2:2 is no format, so its chroma is spread first."""
    if f.chroma == 2 and angle in (90, 270):
        spread = lambda p: np.repeat(p, 2, axis=1)[:, : f.y.shape[1]]
        f = replace(f, cb=spread(f.cb), cr=spread(f.cr), chroma=3)
    left, right, top, bottom = f.crop
    crop = {0: f.crop, 90: (bottom, top, left, right), 180: (right, left, bottom, top), 270: (top, bottom, right, left)}[angle]
    return replace(f.planes(lambda p: np.rot90(p, -angle // 90)), crop=crop)


def transform(f: Frame, steps: list[dict]) -> Frame:
    """The transforms of an item, in their order."""
    for s in steps:
        if s["kind"] == "clap":
            f = aperture(f, s["clap"])
        elif s["kind"] == "irot":
            f = rotate(f, s["irot"]["angle"])
        elif s["kind"] == "imir":
            f = mirror(f, s["imir"]["axis"])
    return f


def attach_alpha(f: Frame, alpha: Frame) -> Frame:
    """The luma of another frame as alpha, taken to the size of the picture by nearest samples and to its depth by shifts."""
    if f.a is not None or min(f.width, f.height, alpha.width, alpha.height) <= 0:
        return f
    rows = np.minimum(np.arange(f.height) * alpha.height // f.height, alpha.height - 1) + alpha.crop[2]
    cols = np.minimum(np.arange(f.width) * alpha.width // f.width, alpha.width - 1) + alpha.crop[0]
    v = alpha.y[np.ix_(rows, cols)].astype(np.int64)
    v = np.where(v == UNSET, 0, v << max(f.depth - alpha.depth, 0) >> max(alpha.depth - f.depth, 0))
    a = np.full(f.y.shape, (1 << f.depth) - 1, np.uint16)
    a[f.crop[2] : f.crop[2] + f.height, f.crop[0] : f.crop[0] + f.width] = v
    return replace(f, a=a)


def paste(canvas: Frame, layer: Frame, x: int, y: int) -> None:
    """Puts a layer on a canvas; what lies outside is cut. Layers are opaque."""
    sx, sy = max(-x, 0), max(-y, 0)
    x, y = max(x, 0), max(y, 0)
    w, h = min(layer.width - sx, canvas.y.shape[1] - x), min(layer.height - sy, canvas.y.shape[0] - y)
    if w <= 0 or h <= 0:
        return
    ox, oy = layer.crop[0] + sx, layer.crop[2] + sy
    canvas.y[y : y + h, x : x + w] = layer.y[oy : oy + h, ox : ox + w]
    if canvas.cb is None or layer.cb is None:
        return
    kx, ky = STEPS[canvas.chroma]
    for to, source in ((canvas.cb, layer.cb), (canvas.cr, layer.cr)):
        part = source[oy // ky : oy // ky + -(-h // ky), ox // kx : ox // kx + -(-w // kx)]
        room = to[y // ky : y // ky + part.shape[0], x // kx : x // kx + part.shape[1]]
        room[...] = part[: room.shape[0], : room.shape[1]]


def to_pixels(f: Frame, form: str = "rgb") -> np.ndarray:
    """Packed 8-bit pixels (height, width, 3 or 4) of the crop; form is rgb, rgba, bgr or bgra."""
    left, _, top, _ = f.crop
    w, h = f.width, f.height
    if w <= 0 or h <= 0:
        raise ValueError("the crop leaves nothing")
    shift, chroma_shift = max(f.depth - 8, 0), max(f.chroma_depth - 8, 0)
    inside = (slice(top, top + h), slice(left, left + w))
    y = f.y[inside].astype(np.int64)
    y = np.where(y == UNSET, 0, y >> shift)
    if f.chroma == 0 or f.cb is None:
        cb = cr = np.full_like(y, 128)
    else:
        kx, ky = STEPS[f.chroma]
        rows = np.minimum((np.arange(h) + top) // ky, f.cb.shape[0] - 1)
        cols = np.minimum((np.arange(w) + left) // kx, f.cb.shape[1] - 1)
        cb, cr = (np.where(p == UNSET, 128, p.astype(np.int64) >> chroma_shift) for p in (f.cb[np.ix_(rows, cols)], f.cr[np.ix_(rows, cols)]))
    matrix = 0 if f.matrix == 0 and f.chroma == 3 else f.matrix if f.matrix in (1, 9) else 6
    if matrix == 0:
        red, green, blue = cr, y, cb
    elif f.full_range:
        k = FULL[matrix]
        b, r = cb - 128, cr - 128
        red, green, blue = (y + (v + 128 >> 8) for v in (k[0] * r, k[1] * b + k[2] * r, k[3] * b))
    else:
        k = LIMITED[matrix]
        base, b, r = (np.clip(y, 16, 235) - 16) * LUMA + 4096, np.clip(cb, 16, 240) - 128, np.clip(cr, 16, 240) - 128
        red, green, blue = (base + v >> 13 for v in (k[0] * r, k[1] * b + k[2] * r, k[3] * b))
    out = [red, green, blue] if form[0] == "r" else [blue, green, red]
    if len(form) == 4:
        a = np.full_like(y, 255) if f.a is None else f.a[inside].astype(np.int64)
        out.append(np.where(a == UNSET, 255, a >> shift) if f.a is not None else a)
    return np.clip(np.stack(out, axis=-1), 0, 255).astype(np.uint8)
