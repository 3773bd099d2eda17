"""Facts, projections and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrain.functions import years
from tunegrain.operators import cleaning, facts, features
from tunegrain.plans.registry import ORDER_YEARS_SQL, order_years, query, rounded, table


@query("age_range", f"select 2025 - max(year) as youngest_song_age, 2025 - min(year) as oldest_song_age "
                    f"from {ORDER_YEARS_SQL} where year > 0")
def age_range(spark, d):
    return facts.age_range(order_years(spark, d))


@query("hottest_songs", """
select song_id, title from (select p_partkey as song_id, p_name as title, p_retailprice as song_hotttnesss,
  p_size::double as duration, length(p_type)::double as energy, length(p_name)::double as tempo from part)
where not isnan(song_hotttnesss)
order by song_hotttnesss desc nulls last, duration asc nulls last, energy desc nulls last, tempo asc nulls last,
  song_id asc limit 10""")
def hottest_songs(spark, d):
    songs = table(spark, d, "part").select(
        F.col("p_partkey").alias("song_id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("song_hotttnesss"),
        F.col("p_size").cast("double").alias("duration"),
        F.length("p_type").cast("double").alias("energy"),
        F.length("p_name").cast("double").alias("tempo"),
    )
    return facts.hottest_songs(songs, 10)


@query("not_nan", "select count(*) as n from lineitem where l_discount is not null and not isnan(l_discount)")
def not_nan(spark, d):
    return facts.not_nan(table(spark, d, "lineitem"), "l_discount").agg(F.count(F.lit(1)).alias("n"))


@query("largest_group", "select p_brand, count(p_brand) as ntrack from part group by p_brand "
                        "order by ntrack desc, p_brand limit 1")
def largest_group(spark, d):
    return facts.top_groups(table(spark, d, "part"), "p_brand", 1, "ntrack")


@query("longest_row", "select l_orderkey, l_linenumber, l_extendedprice from lineitem "
                      "order by l_extendedprice desc nulls last, l_orderkey, l_linenumber limit 1")
def longest_row(spark, d):
    keep = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return facts.longest_row(table(spark, d, "lineitem"), "l_extendedprice", keep, ["l_orderkey", "l_linenumber"])


@query("year_profile", f"select min(year) as min_year, max(year) as max_year, count(year) as total_records "
                       f"from {ORDER_YEARS_SQL}")
def year_profile(spark, d):
    return facts.year_profile(order_years(spark, d))


@query("decade_histogram", f"select (year // 10 * 10)::int as decade, count(*) as n from {ORDER_YEARS_SQL} "
                           f"where year is not null and year <> 0 group by 1 order by 1")
def decade_histogram(spark, d):
    return facts.decade_histogram(order_years(spark, d))


@query("label_summary", """
select count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std,
  round(min(l_extendedprice), 4) as min, round(quantile_cont(l_extendedprice, 0.25), 4) as p25,
  round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.75), 4) as p75,
  round(max(l_extendedprice), 4) as max from lineitem""")
def label_summary(spark, d):
    return rounded(facts.label_summary(table(spark, d, "lineitem"), "l_extendedprice"), 4)


@query("known_year", f"select song_id, year from {ORDER_YEARS_SQL} where year is not null and year <> 0")
def known_year(spark, d):
    return cleaning.known_year(order_years(spark, d)).select("song_id", "year")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("drop_incomplete", """
select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity is not null and not isnan(l_quantity)
  and l_discount is not null and not isnan(l_discount) and l_tax is not null and not isnan(l_tax)""")
def drop_incomplete(spark, d):
    rows = cleaning.drop_incomplete(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("numeric_columns", """
select round(sum(l_linenumber::double), 0) as l_linenumber, round(sum(l_quantity), 0) as l_quantity,
  round(sum(l_extendedprice), 0) as l_extendedprice, round(sum(l_discount), 0) as l_discount,
  round(sum(l_tax), 0) as l_tax from lineitem""")
def numeric_columns(spark, d):
    """Numeric columns without the key columns, found from the schema."""
    lines = table(spark, d, "lineitem")
    kept = cleaning.exclude_tokens(cleaning.numeric_columns(lines), tokens=("key",))
    return lines.agg(*[F.round(F.sum(F.col(c).cast("double")), 0).alias(c) for c in kept])


@query("column_deviations", " union all ".join(
    f"select '{c}' as \"column\", round(stddev_samp({c}), 4) as std from lineitem" for c in _NUMBERS))
def column_deviations(spark, d):
    return rounded(cleaning.column_deviations(table(spark, d, "lineitem"), _NUMBERS), 4)


@query("drop_low_variance", "select vec_id, label from embeddings")
def drop_low_variance(spark, d):
    """Two constant columns are added and must be found and dropped."""
    rows = table(spark, d, "embeddings").select(
        "vec_id", "label", F.lit(1.0).alias("fixed"), F.lit(None).cast("double").alias("missing")
    )
    return cleaning.drop_low_variance(rows, ["label", "fixed", "missing"])[0]


@query("flatten_array", "select vec_id, " + ", ".join(
    f"round(embedding[{i + 1}]::double, 6) as timbre_{i}" for i in range(64)) + " from embeddings")
def flatten_array(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rounded(cleaning.flatten_array(rows, "e", 64, "timbre"))


@query("scale_label", f"select song_id, round((year - 1924.0) / 87.0, 6) as scaled, "
                      f"round((year - 1924.0) / 87.0 * 87.0 + 1924.0, 6) as restored from {ORDER_YEARS_SQL}")
def scale_label(spark, d):
    scaled = order_years(spark, d).select("song_id", years.scale(F.col("year")).alias("scaled"))
    return rounded(scaled.withColumn("restored", years.unscale(F.col("scaled"))))


@query("zscore_label", f"""
with s as (select avg(price) as m, stddev_samp(price) as sd from {ORDER_YEARS_SQL})
select song_id, round((price - m) / sd, 4) as price from {ORDER_YEARS_SQL}, s""")
def zscore_label(spark, d):
    return rounded(features.scale_label(order_years(spark, d).select("song_id", "price"), "price")[0], 4)


@query("clip_to_year", f"""
select song_id, case when v < 1924 then 1924.0 when v > 2011 then 2011.0 else v end as clipped,
  ceil(case when v < 1924 then 1924.0 when v > 2011 then 2011.0 else v end)::int as year
from (select song_id, (1900 + price / 4000)::double as v from {ORDER_YEARS_SQL})""")
def clip_to_year(spark, d):
    raw = order_years(spark, d).select("song_id", (1900 + F.col("price") / 4000).alias("v"))
    clipped = raw.select("song_id", years.clip(F.col("v"), 1924, 2011).alias("clipped"))
    return clipped.withColumn("year", years.to_year(F.col("clipped")))


@query("year_classes", f"""
select year_class, count(*) as n from (select case when y > 1900 and y <= 1950 then '<1950'
  when y > 1950 and y <= 1970 then '1950-1970' when y > 1970 and y <= 1990 then '1970-1990'
  when y > 1990 and y <= 2000 then '1990-2000' when y > 2000 and y <= 2010 then '2000-2010'
  when y > 2010 and y <= 2020 then '>2010' end as year_class
  from (select 1895 + artist % 130 as y from {ORDER_YEARS_SQL})) where year_class is not null group by 1""")
def year_classes(spark, d):
    years_used = order_years(spark, d).select((1895 + F.col("artist") % 130).alias("y"))
    classes = years_used.select(years.year_class(F.col("y")).alias("year_class"))
    return classes.filter(F.col("year_class").isNotNull()).groupBy("year_class").agg(F.count(F.lit(1)).alias("n"))


@query("decade_labels", f"select distinct (year // 10 * 10)::int as decade, (year // 10 * 10 - 1920) / 10.0::double "
                        f"as decade_label from {ORDER_YEARS_SQL}")
def decade_labels(spark, d):
    year = F.col("year")
    return (
        order_years(spark, d)
        .select(years.decade(year).alias("decade"), years.decade_label(year).alias("decade_label"))
        .distinct()
    )
