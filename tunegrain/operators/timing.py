"""Run times from an ordered log: which run a line belongs to, and sums per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track_runs(events: DataFrame, order: Sequence[str] = ("line",)) -> DataFrame:
    """Adds `run_seq` (runs started so far in the log) and `in_section`.

    `events` has log, block, kind and the `order` columns; blocks cut a log into consecutive
    pieces. State is carried in two steps: inside each block, and from the one-row summaries of
    the blocks before it. A single huge log is therefore spread over its blocks.
    A "run" line starts a run and leaves the section, "section" enters it, "end" leaves it.
    """
    order = list(order)
    is_run = (F.col("kind") == "run").cast("bigint")
    marker = F.when(F.col("kind") == "section", F.lit(1)).when(F.col("kind").isin("run", "end"), F.lit(0))
    marked = events.withColumn("_run", is_run).withColumn("_marker", marker)

    blocks = marked.groupBy("log", "block").agg(
        F.sum("_run").alias("_runs"),
        F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.struct(*order))).alias("_last"),
    )
    earlier = Window.partitionBy("log").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "log", "block",
        F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_runs_before"),
        F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.lit(0)).alias("_marker_before"),
    )
    inside = Window.partitionBy("log", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_runs_here", F.sum("_run").over(inside)).withColumn(
        "_marker_here", F.last("_marker", ignorenulls=True).over(inside)
    )
    return local.join(carried, ["log", "block"]).select(
        *events.columns,
        (F.col("_runs_before") + F.col("_runs_here")).alias("run_seq"),
        (F.coalesce("_marker_here", "_marker_before") == 1).alias("in_section"),
    )


def run_times(events: DataFrame, order: Sequence[str] = ("line",)) -> DataFrame:
    """(log, run_seq, run, map_ms, reduce_ms): times inside the sections of each run."""
    tracked = track_runs(events, order).filter(F.col("run_seq") > 0)

    def total(kind: str):
        counted = F.when((F.col("kind") == kind) & F.col("in_section"), F.col("ms"))
        return F.coalesce(F.sum(counted), F.lit(0)).alias(f"{kind}_ms")

    runs = tracked.groupBy("log", "run_seq").agg(F.max("run").alias("run"), total("map"), total("reduce"))
    return runs.filter(F.col("run") > 0)


def timing_report(runs: DataFrame) -> DataFrame:
    """Totals and whole-number averages over all runs of each log."""
    both = F.col("map_ms") + F.col("reduce_ms")
    sums = runs.groupBy("log").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("map_ms").alias("total_map_ms"),
        F.sum("reduce_ms").alias("total_reduce_ms"),
        F.sum(both).alias("total_ms"),
    )
    averages = [
        F.expr(f"total_{part}ms div runs").alias(f"average_{part}ms") for part in ("map_", "reduce_", "")
    ]
    return sums.select("*", *averages)
