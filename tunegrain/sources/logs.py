"""Timing logs of search runs: text lines to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of the log lines.
RUN_PATTERN = r"Run ([0-9]+) - Artist A:"
SECTION_PATTERN = r"===== Timing Information ====="
END_PATTERN = r"============================="
MAP_PATTERN = r"Total time spent by all map tasks \(ms\)=\s*([0-9]+)"
REDUCE_PATTERN = r"Total time spent by all reduce tasks \(ms\)=\s*([0-9]+)"


def read_timing_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, block, line, kind, run, ms), one row per meaningful line.

    `block` is the offset of the file split and `line` grows with the position inside it, so
    both together give the line order without putting a whole file into one task.
    """
    value = F.col("value")
    run = F.regexp_extract(value, RUN_PATTERN, 1)
    map_ms = F.regexp_extract(value, MAP_PATTERN, 1)
    reduce_ms = F.regexp_extract(value, REDUCE_PATTERN, 1)
    kind = (
        F.when(run != "", F.lit("run"))
        .when(map_ms != "", F.lit("map"))
        .when(reduce_ms != "", F.lit("reduce"))
        .when(value.rlike(SECTION_PATTERN), F.lit("section"))
        .when(value.rlike(END_PATTERN), F.lit("end"))
    )
    number = lambda c: F.when(c != "", c.cast("bigint"))
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("log"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            kind.alias("kind"),
            number(run).alias("run"),
            F.coalesce(number(map_ms), number(reduce_ms)).alias("ms"),
        )
        .filter(F.col("kind").isNotNull())
    )
