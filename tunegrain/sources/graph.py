"""Similarity graph sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


def jdbc_options(
    url: str, table: str, partition_column: str | None = None, lower: str | int | None = None,
    upper: str | int | None = None, partitions: int | None = None, **extra: str,
) -> dict[str, str]:
    """Reader options; with a partition column the table is scanned by several tasks."""
    options = {"url": url, "dbtable": table, **extra}
    if partition_column is not None:
        if lower is None or upper is None or partitions is None:
            raise ValueError("a partition column needs lower, upper and partitions")
        options.update(
            partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return options


def graph_reader_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrameReader:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options))


def read_graph_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """The `artists` or `similarity` table of a database; its driver must be on the class path."""
    return graph_reader_jdbc(spark, url, table, **options).load()


def read_adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `id<TAB>a,b,c` to (target, similar); an id without neighbours keeps one null row."""
    parts = F.split(F.col("value"), "\t", 2)
    listed = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("target"), F.explode_outer(listed).alias("similar")
    )


def write_adjacency_text(lists: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The rows of `operators.graph.adjacency` as lines; a long list takes several lines of one id."""
    lists.select(F.concat_ws("\t", "artist_id", "similar_artists").alias("value")).write.mode(mode).text(path)
