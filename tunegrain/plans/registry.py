"""Queries over the test tables, each with the SQL that gives the same rows where SQL can.

The test data has no song table, so every operator runs on a table of the same shape: orders
stand in for songs with a year, embeddings for segment vectors, the customer-order-part-supplier
keys for the similarity graph, events for timing logs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, to compare results of different summation orders."""
    return df.select(
        *[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def order_years(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as songs: id, year and two numbers."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("song_id"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("artist"),
    )


# The same table for SQL texts.
ORDER_YEARS_SQL = (
    "(select o_orderkey as song_id, year(o_orderdate)::int as year, o_totalprice as price, "
    "o_custkey as artist from orders)"
)


def hash_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 15))::bigint"
