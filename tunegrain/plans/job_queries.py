"""Whole jobs from stored input to result, on tables with known answers."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tunegrain.functions.hashing import fraction_cut
from tunegrain.operators import features, graph, timing, training
from tunegrain.plans import corpus, year_prediction
from tunegrain.plans.graph_queries import _EDGES, _PAIRS, _PATH, _SEARCH, _shown, artists, layout
from tunegrain.plans.registry import ORDER_YEARS_SQL, hash_sql, order_years, query, rounded, table
from tunegrain.runtime import broadcast_within, materialize, new_folder
from tunegrain.schema import SIGNATURE_WIDTH
from tunegrain.sources.logs import read_timing_log


@query("timing_log", """
with s as (select user_id % 8 as log, ts, event_id, event_type, floor(value * 100)::bigint as ms,
    count_if(event_type = 'signup') over w as run_seq,
    last_value(case when event_type = 'view' then 1 when event_type in ('signup', 'error') then 0 end ignore nulls) over w as mark
  from events window w as (partition by user_id % 8 order by ts, event_id rows between unbounded preceding and current row))
select log::int as log, run_seq::bigint as run_seq, max(case when event_type = 'signup' then event_id + 1 end) as run,
  coalesce(sum(case when event_type = 'click' and mark = 1 then ms end), 0)::bigint as map_ms,
  coalesce(sum(case when event_type = 'purchase' and mark = 1 then ms end), 0)::bigint as reduce_ms
from s where run_seq > 0 group by 1, 2""")
def timing_log(spark, d):
    """Events written as text logs of search runs, read back and summed by run."""
    ms = F.floor(F.col("value") * 100).cast("string")
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Run "), F.col("event_id") + 1, F.lit(" - Artist A: A, Artist B: B")))
        .when(F.col("event_type") == "view", F.lit("===== Timing Information ====="))
        .when(F.col("event_type") == "error", F.lit("============================="))
        .when(F.col("event_type") == "click", F.concat(F.lit("\t\tTotal time spent by all map tasks (ms)="), ms))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("\t\tTotal time spent by all reduce tasks (ms)="), ms))
        .otherwise("")
    )
    path = new_folder(spark, "logs")
    rows = table(spark, d, "events").withColumn("log", F.col("user_id") % 8).withColumn("line", line)
    ordered = rows.repartition("log").sortWithinPartitions("log", "ts", "event_id")
    ordered.select("log", F.col("line").alias("value")).write.partitionBy("log").text(path)
    runs = timing.run_times(read_timing_log(spark, path))
    return runs.withColumn("log", F.regexp_extract("log", "log=([0-9]+)", 1).cast("int"))


@query("distance_experiment", f"""
with recursive {_EDGES}, {_PAIRS}, asked as (select source, target from pairs),
starts as (select distinct source from asked), {_SEARCH}, {_PATH}""")
def distance_experiment(spark, d):
    return _shown(corpus.distance_experiment(artists(spark, d), layout(spark, d), 8))


@query("search_levels", f"with recursive {_EDGES}, starts as (select 'S1' as source), {_SEARCH} "
                        f"select source, node, dist, backpointer, hits from reached")
def search_levels(spark, d):
    """The levels that a search leaves in its folder."""
    path = new_folder(spark, "levels")
    graph.bfs_levels(layout(spark, d), "S1", state_dir=path)
    return spark.read.parquet(path).select("source", "node", "dist", "backpointer", "hits")


def _customer_years(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("song_id"), (1950 + F.col("c_nationkey") * 2).cast("int").alias("year"),
        features.as_vector(F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal"))).alias("features"),
    )


@query("decade_classes", f"""
select c_custkey as song_id, (1950 + c_nationkey * 2) // 10 * 10 as decade, (1950 + c_nationkey * 2) // 10 * 10 as predicted
from customer where {hash_sql('c_custkey')} >= {fraction_cut(0.8)}""")
def decade_classes(spark, d):
    """A weighted forest over decades that follow from one feature, so every held-out decade must be found."""
    songs = _customer_years(spark, d)
    report, _ = year_prediction.predict_decades(songs)
    names = features.class_index(songs.select((F.floor(F.col("year") / 10) * 10).alias("decade")), "decade")
    predicted = materialize(names.select(F.col("decade").alias("predicted"), F.col("label").cast("double").alias("prediction")), "decades")
    return report.predictions.join(broadcast_within(predicted, predicted.count()), "prediction").select(
        "song_id", F.col("decade").cast("int").alias("decade"), F.col("predicted").cast("int").alias("predicted")
    )


@query("scalar_features", f"""
with r as (select song_id, year, price, artist::double as artist from {ORDER_YEARS_SQL} where year > 0 and song_id % 10 <> 3),
s as (select avg(price) as mp, stddev_samp(price) as sp, avg(artist) as ma, stddev_samp(artist) as sa from r)
select song_id, year, round((price - mp) / sp, 4) as price, round((artist - ma) / sa, 4) as energy from r, s""")
def scalar_features(spark, d):
    """Incomplete rows, identifiers and constant columns are left out, the rest is standardised."""
    songs = order_years(spark, d).select(
        "song_id", "year", F.when(F.col("song_id") % 10 != 3, F.col("price")).alias("price"), F.col("artist").cast("double").alias("energy"),
        F.lit(44100).alias("analysis_sample_rate"), F.col("artist").cast("int").alias("artist_playmeid"), F.lit(1.5).alias("tempo"),
    )
    vectors, names = year_prediction.numeric_features(songs)
    scaled = features.standard_scaler("features", "scaled").fit(vectors).transform(vectors)
    return rounded(features.vector_columns(scaled, "scaled", names, ["song_id", "year"]), 4)


@query("signature_years", f"""
select vec_id as song_id, (1950 + 5 * label)::int as year, (1950 + 5 * label)::double as prediction
from embeddings where {hash_sql('vec_id')} >= {fraction_cut(0.8)} and vec_id % 7 <> 2""")
def signature_years(spark, d):
    """Years from 90-wide signatures whose first value tells the year; songs with a gap in them are left out."""
    first = F.when(F.col("vec_id") % 7 != 2, F.col("label").cast("double"))
    rest = F.slice(F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), SIGNATURE_WIDTH)), 1, SIGNATURE_WIDTH - 1)
    songs = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("song_id"), (1950 + 5 * F.col("label")).cast("int").alias("year"), F.concat(F.array(first), rest).alias("segments_timbre")
    )
    vectors = year_prediction.signature_features(songs)
    report = year_prediction.predict_years(vectors, LinearRegression(featuresCol="features", labelCol="label", regParam=1e-9), lo=1950, hi=2000)
    return report.predictions.select("song_id", "year", F.round(F.col("prediction").cast("double"), 2).alias("prediction"))
