"""Expressions over the release year and its scaled, clipped and binned forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label range and year classes.
YEAR_LO, YEAR_HI = 1924, 2011
CLASS_EDGES = [1900, 1950, 1970, 1990, 2000, 2010, 2020]
CLASS_NAMES = ["<1950", "1950-1970", "1970-1990", "1990-2000", "2000-2010", ">2010"]


def is_known(year: Column) -> Column:
    """Zero and null both mean that the year is unknown."""
    return year.isNotNull() & (year != 0)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(year: Column, first: int = 1920) -> Column:
    return (decade(year) - first) / 10


def year_class(year: Column, edges: Sequence[int] = CLASS_EDGES, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Right-closed classes (lo, hi]; null outside the edges."""
    if len(edges) != len(names) + 1:
        raise ValueError("one more edge than names is needed")
    result = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges, edges[1:], names))):
        result = F.when((year > lo) & (year <= hi), F.lit(name)).otherwise(result)
    return result


def scale(value: Column, lo: float = YEAR_LO, hi: float = YEAR_HI) -> Column:
    return (value - F.lit(float(lo))) / F.lit(float(hi - lo))


def unscale(value: Column, lo: float = YEAR_LO, hi: float = YEAR_HI) -> Column:
    return value * F.lit(float(hi - lo)) + F.lit(float(lo))


def clip(value: Column, lo: float, hi: float) -> Column:
    """Null stays null, which `greatest`/`least` would not keep."""
    return F.when(value < lo, F.lit(float(lo))).when(value > hi, F.lit(float(hi))).otherwise(value)


def to_year(value: Column) -> Column:
    return F.ceil(value).cast("int")


def bin_edges(lo: int, hi: int, width: int) -> list[int]:
    return list(range(lo, hi + width, width))


def bin_index(value: Column, lo: int, hi: int, width: int, merge_outside: bool = False) -> Column:
    """Half-open bins 0..n-1; below `lo` is -1 and at or above the last edge is n.

    With `merge_outside` both tails share bin n.
    """
    edges = bin_edges(lo, hi, width)
    n = len(edges) - 1
    below = n if merge_outside else -1
    inside = F.floor((value - lo) / width).cast("int")
    return F.when(value < lo, F.lit(below)).when(value >= edges[-1], F.lit(n)).otherwise(inside)
