"""Columns that are computed once, and running values within arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, in filters too."""
    return F.transform(F.array(value), f)[0]


def fixed(x: Column, places: int) -> Column:
    """A double to so many places as C and Python print it: by its exact binary value, ties to the even digit. (``format_string`` rounds
    the shortest decimal instead, so 0.1235, which is a little less than that in binary, would become 0.124.)"""
    scale = float(10**places)
    size = F.abs(x)
    # The product with the scale and what its rounding hides, by Veltkamp's splitting, are exact together.
    big = size * F.lit(134217729.0)
    high = big - (big - size)
    product = size * F.lit(scale)
    hidden = (high * F.lit(scale) - product) + (size - high) * F.lit(scale)
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((hidden > 0) | ((hidden == 0) & (whole % 2 == 1))))
    digits = F.format_string(f"%.{places}f", (whole + up.cast("int")) / F.lit(scale))
    # Null, no number, and what is too great for a long pass as they are.
    return F.when(F.isnan(x) | (size >= 1e13) | x.isNull(), F.format_string(f"%.{places}f", x)).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), digits))
