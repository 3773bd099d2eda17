"""Scans, writers, merging and compaction, and timing logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrain.operators import graph, timing
from tunegrain.plans.graph_queries import _EDGES, artists, edges
from tunegrain.plans import corpus
from tunegrain.plans.registry import ORDER_YEARS_SQL, order_years, query, rounded, table
from tunegrain.runtime import new_folder
from tunegrain.schema import SEGMENTS_SCHEMA
from tunegrain.sources import graph as graph_sources
from tunegrain.sources import songs


@query("read_songs", f"select song_id::varchar as song_id, year from {ORDER_YEARS_SQL} where year >= 1998")
def read_songs(spark, d):
    """Orders written as a song table, then two of its columns scanned through the song schema."""
    path = new_folder(spark, "songs")
    rows = order_years(spark, d).select(F.col("song_id").cast("string"), "year", F.col("price").alias("duration"))
    songs.write_songs(rows, path)
    return songs.read_songs(spark, path, columns=["song_id", "year"]).filter(F.col("year") >= 1998)


@query("merge_tables", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer group by 1")
def merge_tables(spark, d):
    """One table per market segment, merged into one."""
    folder = new_folder(spark, "segments")
    whole = table(spark, d, "customer")
    # one partitioned write: each folder is a table of its own
    whole.withColumn("part", F.col("c_mktsegment")).write.partitionBy("part").parquet(f"{folder}/parts")
    names = [r[0] for r in whole.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # five segments
    paths = [f"{folder}/parts/part={name}" for name in names]
    merged = songs.merge_tables(spark, paths, f"{folder}/merged")
    return merged.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("compact_small_files", "select c_nationkey, count(*) as n from customer group by 1")
def compact_small_files(spark, d):
    """Customers in one folder per nation, compacted into one table."""
    folder = new_folder(spark, "small")
    rows = table(spark, d, "customer")
    rows.withColumn("nation", F.col("c_nationkey")).write.partitionBy("nation").parquet(f"{folder}/in")
    compacted = songs.compact_small_files(spark, f"{folder}/in", "*.parquet", f"{folder}/out")
    return compacted.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("compact_corpus", """
with v as (select vec_id::varchar as song_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
a as (select song_id, avg(v) as m, stddev_pop(v) as s, max(v) as t from v group by 1),
c as (select song_id, avg(v) filter (where i % 12 = 1) as mean0, var_samp(v) filter (where i % 12 = 0) as cov11 from v where i <= 60 group by 1)
select song_id, round(m, 6) as bars_confidence_mean, round(s, 6) as bars_confidence_std, round(t, 6) as bars_confidence_max,
  round(m, 6) as segments_loudness_max_mean, round(s, 6) as segments_loudness_max_std, 90 as width, round(mean0, 6) as first_mean,
  round(cov11, 6) as last_covariance from a join c using (song_id)""")
def compact_corpus(spark, d):
    """Vectors as the raw arrays of songs, in many small files below several folders, to the song table."""
    folder = new_folder(spark, "corpus")
    vector = F.col("embedding").cast("array<double>")
    raw = table(spark, d, "embeddings").select(
        "label",
        *[F.col("vec_id").cast("string").alias(c) if c == "song_id" else vector.alias(c) for c in SEGMENTS_SCHEMA.names],
    )
    raw.repartition(4).write.partitionBy("label").parquet(f"{folder}/in")
    made = corpus.compact_corpus(spark, f"{folder}/in", f"{folder}/out")
    shown = ["song_id", *[f"bars_confidence_{s}" for s in ("mean", "std", "max")],
             "segments_loudness_max_mean", "segments_loudness_max_std"]
    timbre = F.col("segments_timbre")
    return rounded(made.select(
        *shown, F.size(timbre).alias("width"), F.get(timbre, F.lit(0)).alias("first_mean"),
        F.get(timbre, F.lit(89)).alias("last_covariance"),
    ))


@query("adjacency_text", f"with {_EDGES} select src as target, count(*) as n, min(dst) as first, max(dst) as last from raw group by 1")
def adjacency_text(spark, d):
    """Adjacency lists written as text lines and read back as edges."""
    path = new_folder(spark, "adjacency")
    graph_sources.write_adjacency_text(graph.adjacency(artists(spark, d), edges(spark, d)), path)
    read = graph_sources.read_adjacency_text(spark, path).filter(F.col("similar").isNotNull())
    return read.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.min("similar").alias("first"), F.max("similar").alias("last")
    )


def _log(spark, d):
    """Events of a user as a log: signups start runs, views and errors enter and leave sections."""
    kinds = {"signup": "run", "view": "section", "error": "end", "click": "map", "purchase": "reduce"}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, d, "events").select(
        F.col("user_id").alias("log"),
        F.to_date("ts").alias("block"),
        "ts",
        "event_id",
        names[F.col("event_type")].alias("kind"),
        F.when(F.col("event_type") == "signup", F.col("event_id") + 1).alias("run"),
        F.floor(F.col("value") * 100).alias("ms"),
    )


_RUNS = """
with s as (select user_id as log, ts, event_id, event_type, floor(value * 100)::bigint as ms,
    count_if(event_type = 'signup') over w as run_seq,
    last_value(case when event_type = 'view' then 1 when event_type in ('signup', 'error') then 0 end ignore nulls) over w as mark
  from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)),
runs as (select log, run_seq::bigint as run_seq, max(case when event_type = 'signup' then event_id + 1 end) as run,
    coalesce(sum(case when event_type = 'click' and mark = 1 then ms end), 0)::bigint as map_ms,
    coalesce(sum(case when event_type = 'purchase' and mark = 1 then ms end), 0)::bigint as reduce_ms
  from s where run_seq > 0 group by 1, 2)"""


@query("run_times", f"{_RUNS} select * from runs")
def run_times(spark, d):
    return timing.run_times(_log(spark, d), ["ts", "event_id"])


@query("timing_report", f"""{_RUNS}, t as (select log, count(*) as runs, sum(map_ms)::bigint as total_map_ms,
  sum(reduce_ms)::bigint as total_reduce_ms, sum(map_ms + reduce_ms)::bigint as total_ms from runs group by 1)
select *, total_map_ms // runs as average_map_ms, total_reduce_ms // runs as average_reduce_ms,
  total_ms // runs as average_ms from t""")
def timing_report(spark, d):
    return timing.timing_report(timing.run_times(_log(spark, d), ["ts", "event_id"]))
