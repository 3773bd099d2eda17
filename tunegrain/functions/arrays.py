"""Row-local statistics over array columns; no shuffle is needed for any of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def array_mean(array: Column) -> Column:
    """Null for a null or an empty array, and for one with a null element."""
    total = F.aggregate(array.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(array))


def array_std(array: Column, mean: Column) -> Column:
    """Population standard deviation around a `mean` that is already a column.

    An expression in its place would be evaluated again for every element.
    """
    squares = F.aggregate(
        array.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)
    )
    return F.sqrt(F.try_divide(squares, F.size(array)))


def array_top(array: Column) -> Column:
    return F.array_max(array.cast("array<double>"))


def signature(flat: Column, dims: int) -> Column:
    """Means and upper-triangle sample covariances of a flat row-major n x dims array, in the row itself.

    Runs in Arrow batches with numpy: the built-in route, one row per segment under dims * (dims + 3) / 2
    aggregates, was measured to be slower by far and has to shuffle. A ragged tail is left out; a single
    segment has null covariances; no complete segment, or a null element, gives null.
    """

    @F.arrow_udf("array<double>")
    def summarize(arrays: pa.Array) -> pa.Array:
        upper = np.triu_indices(dims)
        unknown = [None] * len(upper[0])
        values = arrays.values.to_numpy(zero_copy_only=False)
        gaps = np.flatnonzero(~arrays.values.is_valid().to_numpy(zero_copy_only=False))
        offsets, present = arrays.offsets.to_numpy(), arrays.is_valid().to_numpy(zero_copy_only=False)
        gapless = np.searchsorted(gaps, offsets[:-1]) == np.searchsorted(gaps, offsets[1:])
        out = []
        for lo, hi, usable in zip(offsets[:-1], offsets[1:], present & gapless):
            n = (hi - lo) // dims
            if not usable or n == 0:
                out.append(None)
                continue
            rows = values[lo : lo + n * dims].reshape(n, dims)
            means = rows.mean(axis=0)
            if n == 1:
                out.append([*means, *unknown])
                continue
            centred = rows - means
            out.append(np.concatenate([means, (centred.T @ centred)[upper] / (n - 1)]))
        return pa.array(out, pa.list_(pa.float64()))

    return summarize(flat.cast("array<double>"))


def is_complete(array: Column, width: int) -> Column:
    """True for an array of exactly `width` values without null or NaN."""
    values = array.cast("array<double>")
    known = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(values) == width) & known, F.lit(False))
