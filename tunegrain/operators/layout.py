"""A similarity graph laid out once: dense node numbers in name order and edges in buckets.

Searches join on numbers, and their levels lie in the same buckets as the edges, so no level moves the edges or
what was reached before. Nodes with very many edges would make one bucket of any size; their
edges are kept apart, spread evenly, and meet a broadcast of the few frontier rows of such nodes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.operators.ranking import with_rank
from tunegrain.runtime import broadcast_within, hash_side, materialize, new_folder

HUB_EDGES = 4_000_000  # a node with more edges is kept out of the buckets


class BucketTable:
    """A Parquet table in `buckets` buckets of one column, in the shared folder; further rows can be appended.

    Spark knows buckets only of tables in its catalog, so it has an entry there until `close`; the files stay.
    """

    def __init__(self, spark: SparkSession, column: str, buckets: int, path: str, partition_by: str | None = None):
        self.spark, self.column, self.buckets, self.path, self.partition_by = spark, column, buckets, path, partition_by
        self.name = f"tunegrain_{uuid.uuid4().hex}"

    def append(self, df: DataFrame) -> None:
        writer = df.write.format("parquet").mode("append").bucketBy(self.buckets, self.column).option("path", self.path)
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The rows without their buckets; stays readable after `close`."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


@dataclass
class Side:
    """Edges seen from one of their ends: near, far, copies; in buckets of near, those of hubs apart."""

    edges: DataFrame
    hub_edges: DataFrame | None
    hubs: DataFrame | None  # near
    hub_count: int

    def step(self, frontier: DataFrame, rows_per_node: int = 1) -> DataFrame:
        """`frontier` (node, ...) along its edges, with near, far and copies; it has at most `rows_per_node` rows of a node.

        One row of a node is hashed, bucket by bucket, so the edges need no sort.
        """
        built = frontier.hint("shuffle_hash") if rows_per_node == 1 else frontier
        moved = built.join(self.edges, frontier["node"] == self.edges["near"])
        if self.hub_edges is None:
            return moved
        few = frontier.join(broadcast_within(self.hubs, self.hub_count), frontier["node"] == self.hubs["near"], "left_semi")
        hot = self.hub_edges.join(broadcast_within(few, self.hub_count * rows_per_node), F.col("near") == F.col("node"))
        return moved.unionByName(hot)


@dataclass
class Layout:
    """names (name, id: ranks of all nodes in name order), edges forward and, if asked for, backward.

    The backward side is laid out from the forward one by the first search that needs it.
    """

    spark: SparkSession
    names: DataFrame
    node_type: str
    buckets: int
    forward: Side
    turned: DataFrame | None  # all edges seen from their far ends
    turned_hubs: DataFrame

    @cached_property
    def backward(self) -> Side | None:
        return None if self.turned is None else _side(self.turned, self.turned_hubs, self.buckets)[0]

    def levels(self) -> BucketTable:
        """An empty state (node, ..., dist) in the buckets of the edges, one folder for each dist."""
        return BucketTable(self.spark, "node", self.buckets, new_folder(self.spark, "levels"), "dist")

    def named(self, df: DataFrame, column: str) -> DataFrame:
        """Node numbers in `column` replaced by names; null stays null."""
        names = self.names.select(F.col("id").alias(f"_id_{column}"), F.col("name").alias(f"_name_{column}"))
        found = df.join(names, F.col(column) == F.col(f"_id_{column}"), "left")
        return found.withColumn(column, F.col(f"_name_{column}")).drop(f"_id_{column}", f"_name_{column}")


def _side(edges: DataFrame, hubs: DataFrame, buckets: int, copied: bool = False) -> tuple[Side, DataFrame]:
    """The side of `edges` (near, far, copies) with `hubs` (near) apart, and all its edges as a plain table.

    With `copied`, an edge may have several rows, whose copies are added up.
    """
    spark = edges.sparkSession

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("near", "far").agg(F.sum("copies").alias("copies")) if copied else rows

    count = hubs.count()
    many = None
    if count:
        edges = materialize(edges, "edges")
        many = materialize(added(edges.join(broadcast_within(hubs, count), "near", "left_semi")), "hub-edges")
        edges = edges.join(broadcast_within(hubs, count), "near", "left_anti")
    table = BucketTable(spark, "near", buckets, new_folder(spark, "edges"))
    # rows of an edge meet in its bucket, so the one shuffle deals out the buckets and adds up the copies
    table.append(added(edges.repartition(buckets, "near")))
    stored, plain = table.read(), table.files()
    table.close()  # what was read keeps its files and buckets
    return Side(stored, many, hubs if count else None, count), plain if many is None else plain.unionByName(many)


def lay_out(edges: DataFrame, both: bool = False, buckets: int | None = None, hub_edges: int = HUB_EDGES) -> Layout:
    """Edges (target, similar) laid out for searches along them and, with `both`, also against them.

    Every edge is kept once with its number of copies; edges without an end are left out. Equal tables give equal numbers.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = edges.select(F.col("target").alias("src"), F.col("similar").alias("dst")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    # every name with its edges on either side, copies counted
    end = [F.struct(F.col(c).alias("name"), F.lit(int(c == "src")).alias("out"), F.lit(int(c == "dst")).alias("into")) for c in ("src", "dst")]
    ends = raw.select(F.inline(F.array(*end))).groupBy("name").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    ranked = with_rank(ends, ["name"], "id")
    hubs = materialize(ranked.filter((F.col("out") > hub_edges) | (F.col("into") > hub_edges)).select(F.col("id").alias("near"), "out", "into"), "hubs")
    names = materialize(ranked.select("name", "id"), "names")  # so that joins are planned by its size
    nodes = names.count()

    def number(of: str) -> tuple[DataFrame, Column]:
        renamed = names.select(F.col("name").alias(f"{of}_name"), F.col("id").alias(f"{of}_id"))
        return hash_side(renamed, nodes), F.col(of) == F.col(f"{of}_name")

    numbered = raw.join(*number("src")).join(*number("dst"))
    numbered = numbered.select(F.col("src_id").alias("near"), F.col("dst_id").alias("far"), F.lit(1).cast("long").alias("copies"))
    forward, whole = _side(numbered, hubs.filter(F.col("out") > hub_edges).select("near"), buckets, copied=True)
    turned = whole.select(F.col("far").alias("near"), F.col("near").alias("far"), "copies") if both else None
    turned_hubs = hubs.filter(F.col("into") > hub_edges).select("near")
    return Layout(spark, names, raw.schema["src"].dataType.simpleString(), buckets, forward, turned, turned_hubs)
