"""Column helpers: running values of arrays, and keys of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running ``op`` (sum, greatest, least) of an array: each step doubles how far back a place has looked, so n values
    take n log n steps and no array grows by single values."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)

    def doubled(a: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: F.when(i >= back, op(x, a[i - back])).otherwise(x))

    return F.aggregate(steps, values, doubled)


def row_key(id_: Column, text: Column) -> Column:
    """A digest of a row's id and text (no null); a null id is like no other id."""
    name = id_.cast("string")
    return F.md5(F.concat(F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-")), F.lit(":"), text))
