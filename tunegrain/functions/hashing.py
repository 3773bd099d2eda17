"""Order-independent pseudo-randomness.

`rand()` and `randomSplit` depend on the partition layout, so a retried or re-planned task
may draw other rows. A keyed digest gives each row the same draw on every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def key_hash(key: str | Column, seed: int) -> Column:
    """Uniform integer in [0, 2**60) from the row's key."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", column.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def fraction_cut(fraction: float) -> int:
    """Hash value below which about `fraction` of all keys fall."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    return int(fraction * 2**HASH_BITS)
