"""Row and column cleaning before any model sees the table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import filterfalse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.functions import years

# Name tokens of columns that are identifiers, not features.
ID_TOKENS = ("id", "playmeid", "sample_rate", "7digital")

def known_year(df: DataFrame, col: str = "year") -> DataFrame:
    return df.filter(years.is_known(F.col(col)))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a null or NaN in `subset` (default: any column) are left out."""
    return df.na.drop(subset=list(subset) if subset is not None else None)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ("year",)) -> list[str]:
    """Columns of any numeric type, small integers and decimals included, in table order."""
    numbers = df.select(*[c for c in df.columns if c not in set(exclude)])
    return [name for name in numbers.columns if isinstance(numbers.schema[name].dataType, T.NumericType)]


def exclude_tokens(cols: Sequence[str], tokens: Sequence[str] = ID_TOKENS, mode: str = "substring") -> list[str]:
    """Leave out columns whose name contains a token.

    "substring" also drops every `*_confidence*` column, because "id" is part of that word;
    "token" compares whole name parts and keeps them.
    """
    forms = {"substring": "(?:{})", "token": "(?:^|_)(?:{})(?:id)?(?:_|$)"}
    if mode not in forms:
        raise ValueError(f"unknown mode {mode!r}")
    named = re.compile(forms[mode].format("|".join(re.escape(t) for t in tokens)), re.IGNORECASE)
    return list(filterfalse(named.search, cols)) if tokens else list(cols)


def column_deviations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, std): all sample deviations from a single pass."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "std")


def low_variance_columns(df: DataFrame, cols: Sequence[str], min_std: float = 1e-8) -> list[str]:
    weak = column_deviations(df, cols).filter(F.col("std").isNull() | (F.col("std") < min_std))
    names = {row["column"] for row in weak.collect()}  # at most one row per column
    return [c for c in cols if c in names]


def drop_low_variance(df: DataFrame, cols: Sequence[str], min_std: float = 1e-8) -> tuple[DataFrame, list[str]]:
    """`df` without its near-constant columns, and the names that are left."""
    constant = low_variance_columns(df, cols, min_std)
    return df.drop(*constant), required(cols, constant)


def required(cols: Sequence[str], dropped: Sequence[str]) -> list[str]:
    """`cols` without `dropped`; a model cannot do without any column."""
    left = [c for c in cols if c not in set(dropped)]
    if not left:
        raise ValueError("no feature column is left after cleaning")
    return left


def flatten_arrays(df: DataFrame, widths: dict[str, int], prefixes: dict[str, str] | None = None) -> DataFrame:
    """Fixed-length arrays to one column per element; elements past the end of a short array are null."""
    prefixes = prefixes or {}
    others = [c for c in df.columns if c not in widths]
    flat = [
        F.get(F.col(name), F.lit(i)).alias(f"{prefixes.get(name, name)}_{i}")
        for name, width in widths.items()
        for i in range(width)
    ]
    return df.select(*others, *flat)


def flatten_array(df: DataFrame, col: str, n: int, prefix: str) -> DataFrame:
    return flatten_arrays(df, {col: n}, {col: prefix})
