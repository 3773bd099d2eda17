"""Global row numbers without a one-task window: a range-partitioned sort and an offset per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.runtime import broadcast_within, materialize

_ROW_BITS = 33  # monotonically_increasing_id counts rows of a partition below this bit


def with_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds 0-based `name` in the order of `order`; rows that tie are numbered in any order.

    The sorted rows are written once, so the numbers do not change with retries. Only one row
    for each partition is ever brought together.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    stored = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = stored.withColumn("_part", part).join(broadcast_within(offsets, partitions), "_part")
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return numbered.withColumn(name, F.col("_offset") + within).drop("_part", "_place", "_offset")
