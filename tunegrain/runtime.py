"""Session defaults, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast hint is only given to a side that is proven to stay below both.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
_TYPE_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}


def build_session(app: str = "tunegrain", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; cluster sizing stays with spark-submit or `conf`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The dozens of covariances of a signature need over 300 buffer fields; beyond the limit Spark
        # runs them outside whole-stage code, more than three times slower.
        .config("spark.sql.codegen.maxFields", "2000")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can reach, as named by spark.checkpoint.dir.

    A session that runs in one process may do without: it then gets a temporary folder of its own.
    Anywhere else such a folder would be on one machine and be lost with it, so the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tunegrain-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the optimizer the true size
    of the table, so that joins against it pick their strategy from a measured size.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, row_bound: int) -> DataFrame:
    """Hint a broadcast only if `row_bound`, a proven upper bound on the rows, is small, and so are the rows together.

    Columns without a fixed width count as 100 bytes each.
    """
    width = sum(_TYPE_BYTES.get(kind, 100) for _, kind in df.dtypes)
    return F.broadcast(df) if row_bound <= BROADCAST_ROWS and row_bound * width <= BROADCAST_BYTES else df


def hash_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint that a join hashes `df`, whose `rows` rows have different keys, whole or by partitions: the other side is not sorted."""
    small = broadcast_within(df, rows)
    return df.hint("shuffle_hash") if small is df else small
