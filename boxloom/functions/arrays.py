"""What expressions on the arrays of one row share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def below(rows: Column, value: Column, of: Callable[[Column], Column] = lambda x: x, most: int = 1 << 16) -> Column:
    """How many rows of an array that rises by `of` are below value: a binary search, of as many steps as 2 * `most` has bits."""
    half = lambda a: F.call_function("div", a["lo"] + a["hi"], F.lit(2)).cast("int")

    def step(a: Column, _: Column) -> Column:
        return let(half(a), lambda m: F.when(a["lo"] >= a["hi"], a).when(of(F.get(rows, m)) < value, F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))

    begin = F.struct(F.lit(0).alias("lo"), F.size(rows).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), begin, step, lambda a: a["lo"])


def number(count: Column) -> Column:
    """0 .. count - 1, for a count of at least 1."""
    return F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)
