from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunegrain.functions import years
from tunegrain.operators import facts, quantiles

SONGS = [
    ("S1", "A", "R1", "P", 1.0, 100.0, 0.9, 90.0, 1922),
    ("S2", "B", "R1", "P", 1.0, 100.0, 0.9, 80.0, 2011),
    ("S3", "C", "R1", "Q", math.nan, 50.0, 0.1, 60.0, 0),
    ("S4", "D", "R2", "Q", None, 3034.9, None, None, None),
    ("S5", "E", None, "Q", 0.5, None, 0.5, 120.0, 1999),
]


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame(
        SONGS, "song_id string, title string, release string, artist_name string, song_hotttnesss double, "
               "duration double, energy double, tempo double, year int"
    )


def test_facts(songs):
    assert tuple(facts.age_range(songs).first()) == (14, 103)
    assert [tuple(r) for r in facts.hottest_songs(songs, 2).collect()] == [("S2", "B"), ("S1", "A")]
    assert tuple(facts.top_groups(songs, "release", 1, "ntrack").first()) == ("R1", 3)
    assert tuple(facts.longest_row(songs, "duration", ["artist_name", "duration"]).first()) == ("Q", 3034.9)
    assert tuple(facts.year_profile(songs).first()) == (0, 2011, 4)
    assert [tuple(r) for r in facts.decade_histogram(songs).collect()] == [(1920, 1), (1990, 1), (2010, 1)]


def test_top_k_needs_no_full_sort(songs):
    plan = facts.hottest_songs(songs, 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_year_expressions(spark):
    df = spark.createDataFrame([(y,) for y in (1900, 1901, 1950, 1951, 2010, 2011, 2020, 2021)], "y int")
    classes = [r[0] for r in df.select(years.year_class(F.col("y"))).collect()]
    assert classes == [None, "<1950", "<1950", "1950-1970", "2000-2010", ">2010", ">2010", None]
    bins = spark.createDataFrame([(y,) for y in (1923, 1924, 1928, 1929, 2013, 2014)], "y int")
    y = F.col("y")
    assert [r[0] for r in bins.select(years.bin_index(y, 1924, 2011, 5)).collect()] == [-1, 0, 0, 1, 17, 18]
    merged = bins.select(years.bin_index(y, 1924, 2011, 5, merge_outside=True)).collect()
    assert [r[0] for r in merged] == [18, 0, 0, 1, 17, 18]
    values = spark.createDataFrame([(None,), (1900.5,), (1999.2,), (2050.0,)], "v double")
    clipped = values.select(years.clip(F.col("v"), 1924, 2011).alias("c")).select("c", years.to_year(F.col("c")))
    assert [tuple(r) for r in clipped.collect()] == [(None, None), (1924.0, 1924), (1999.2, 2000), (2011.0, 2011)]
    back = df.select(years.unscale(years.scale(F.col("y"))).alias("b"), "y").collect()
    assert all(r.b == pytest.approx(r.y) for r in back)


@pytest.mark.parametrize("sort_rows,buckets", [(100_000, 4096), (5, 8)])
def test_exact_percentiles(spark, monkeypatch, sort_rows, buckets):
    monkeypatch.setattr(quantiles, "SORT_ROWS", sort_rows)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    random = np.random.default_rng(3)
    plain = random.normal(size=600) * 1000
    hot = np.where(random.random(600) < 0.4, 7.0, random.exponential(size=600) * 1e6)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(plain, hot)], "a double, b double, c double")
    df = df.unionByName(spark.createDataFrame([(None, math.nan, None)], df.schema))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    rows = {(r["column"], r["prob"]): r["value"] for r in quantiles.exact_percentiles(df, ["a", "b", "c"], probs).collect()}
    for name, values in (("a", plain), ("b", hot)):
        for p in probs:
            assert rows[(name, p)] == pytest.approx(np.quantile(values, p))
    assert rows[("c", 0.5)] is None


def test_label_summary(spark):
    row = facts.label_summary(spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double"), "v").first()
    assert (row.n, row["mean"], row.p25, row.p50, row.p75) == (5, 3.0, 2.0, 3.0, 4.0)
