"""From raw files to the song table, and from the artist tables to distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunegrain.operators import graph, sampling, segments
from tunegrain.schema import SEGMENTS_SCHEMA
from tunegrain.sources import songs


def compact_corpus(spark: SparkSession, folder: str, out: str, glob: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    """Per-song analysis files below `folder` to one table of summary features."""
    return songs.compact_small_files(
        spark, folder, glob, out, fmt, schema=SEGMENTS_SCHEMA, transform=segments.song_features
    )


def distance_experiment(
    artists: DataFrame, similarity: DataFrame | graph.Layout, pairs: int, max_depth: int = graph.MAX_DEPTH, seed: int = 42
) -> DataFrame:
    """Shortest paths of `pairs` random artist pairs, all advanced together."""
    drawn = sampling.random_pairs(artists, "artist_id", pairs, seed)
    return graph.shortest_paths(similarity, drawn.select("source", "target"), max_depth)
