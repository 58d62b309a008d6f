"""Colour and sample arithmetic as SQL expressions: integers only, so any engine gives the same results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Red from Cr, green from Cb, green from Cr, blue from Cb; in 256ths for full range, in 8192ths for limited.
FULL = {1: (403, -48, -120, 475), 9: (377, -42, -146, 482), 6: (359, -88, -183, 454)}
LIMITED = {1: (14744, -1754, -4383, 17373), 9: (13806, -1541, -5349, 17615), 6: (13126, -3222, -6686, 16591)}
LUMA = 9576


def div(a: Column, b: Column | int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def used_matrix(matrix: Column, chroma_format: Column) -> Column:
    """The matrix that a picture is converted by: identity needs full chroma, and what is unspecified or unknown is BT.601."""
    return F.when((matrix == 0) & (chroma_format == 3), 0).when(matrix.isin(1, 9), matrix).otherwise(6)


def coefficient(matrix: Column, full: Column, place: int) -> Column:
    pick = lambda table: F.when(matrix == 1, table[1][place]).when(matrix == 9, table[9][place]).otherwise(table[6][place])
    return F.when(full, pick(FULL)).otherwise(pick(LIMITED))


def to_rgb(y: Column, cb: Column, cr: Column, matrix: Column, full: Column) -> Column:
    """struct<r, g, b> of 8-bit samples."""
    c = [coefficient(matrix, full, i) for i in range(4)]
    ly, lb, lr = clamp(y, 16, 235), clamp(cb, 16, 240) - 128, clamp(cr, 16, 240) - 128
    b, r = cb - 128, cr - 128

    def mix(of_full: Column, of_limited: Column) -> Column:
        return clamp(F.when(full, y + F.shiftright(of_full + 128, 8)).otherwise(F.shiftright((ly - 16) * LUMA + of_limited + 4096, 13)))

    red, green, blue = mix(c[0] * r, c[0] * lr), mix(c[1] * b + c[2] * r, c[1] * lb + c[2] * lr), mix(c[3] * b, c[3] * lb)
    plain = matrix == 0
    return F.struct(F.when(plain, clamp(cr)).otherwise(red).cast("int").alias("r"), F.when(plain, clamp(y)).otherwise(green).cast("int").alias("g"), F.when(plain, clamp(cb)).otherwise(blue).cast("int").alias("b"))


def to_8_bits(value: Column, depth: Column) -> Column:
    """A sample of `depth` bits on the scale of 8: the high bits, or scaled up and rounded."""
    most = left(F.lit(1), F.least(depth, F.lit(8))) - 1
    return F.when(depth > 8, right(value, F.greatest(depth - 8, F.lit(0))).bitwiseAND(255)).when(depth == 8, value.bitwiseAND(255)).otherwise(div(value * 255 + div(most, 2), most)).cast("int")


def alpha_sample(value: Column, source_depth: Column, depth: Column) -> Column:
    """An alpha sample on the scale of another depth."""
    up, down = F.greatest(depth - source_depth, F.lit(0)), F.greatest(source_depth - depth, F.lit(0))
    return right(left(value, up), down)


def tile_origin(no: Column, columns: Column, tile_width: Column, tile_height: Column) -> Column:
    """struct<x, y> of the no-th tile of a grid."""
    return F.struct(((no % columns) * tile_width).alias("x"), (div(no, columns) * tile_height).alias("y"))


def nearest(x: Column, size: Column, source_size: Column) -> Column:
    """The sample of a plane of source_size that a position x of `size` takes."""
    return F.least(div(x.cast("bigint") * source_size, size), source_size - 1)
