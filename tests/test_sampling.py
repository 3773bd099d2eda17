from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunegrain.operators import sampling


@pytest.fixture(scope="module")
def years(spark):
    """One bin holds most of the rows, others a handful."""
    hot = spark.range(3000).select("id", F.lit(2001).alias("year"))
    few = spark.range(3000, 3040).select("id", (F.lit(1924) + F.col("id") % 5).cast("int").alias("year"))
    edge = spark.range(4000, 4007).select("id", F.lit(1900).alias("year"))
    none = spark.range(5000, 5003).select("id", F.lit(None).cast("int").alias("year"))
    return hot.unionByName(few).unionByName(edge).unionByName(none)


def test_split_ignores_the_layout(years):
    train, test = sampling.split(years, "id", 0.8)
    again, _ = sampling.split(years.repartition(13), "id", 0.8)
    ids = {r.id for r in train.collect()}
    assert ids == {r.id for r in again.collect()}
    assert not ids & {r.id for r in test.collect()} and len(ids) + test.count() == years.count()
    assert 0.75 < len(ids) / years.count() < 0.85


def test_balance_bins_gives_exactly_n(years):
    rows = sampling.balance_bins(years, "year", "id", n=100).collect()
    assert Counter(r.bin for r in rows) == {-1: 100, 0: 100, 15: 100}
    hot = [r for r in rows if r.bin == 15]
    assert len({r.id for r in hot}) == 100 and {r.replica for r in hot} == {0}
    copies = Counter(r.id for r in rows if r.bin == 0)
    assert set(copies.values()) <= {2, 3} and len(copies) == 40
    merged = sampling.balance_bins(years, "year", "id", n=100, merge_outside=True).collect()
    assert Counter(r.bin for r in merged) == {0: 100, 15: 100, 18: 100}


def test_balance_ignores_the_layout(years):
    key = lambda df: sorted(map(tuple, df.collect()))
    one = key(sampling.balance_bins(years, "year", "id", n=64))
    two = key(sampling.balance_bins(years.repartition(11), "year", "id", n=64))
    assert one == two


def test_era_quota_and_balance(years):
    assert sampling.era_quota(sampling.ERA_EDGES, sampling.ERA_TARGETS, 5, 50) == [333, 375, 250, 125]
    rows = sampling.balance_eras(years, "year", "id").collect()
    assert Counter((r.era, r.bin) for r in rows) == {(0, 0): 333, (3, 2): 125}
    floor = sampling.balance_eras(years, "year", "id", targets=[10, 10, 10, 10]).collect()
    assert set(Counter((r.era, r.bin) for r in floor).values()) == {50}


def test_stratified_split(years):
    rows = sampling.stratified_split(years, "year", "id", 0.8).collect()
    assert len(rows) == years.count() and None in {r.year for r in rows}
    for year, n in Counter(r.year for r in rows).items():
        assert sum(r.is_train for r in rows if r.year == year) == int(n * 0.8 + 0.5)


def test_sample(years):
    drawn = {r.id for r in sampling.sample(years, "id", 0.1).collect()}
    assert drawn == {r.id for r in sampling.sample(years.repartition(13), "id", 0.1).collect()}
    assert 0.07 < len(drawn) / years.count() < 0.13
    assert 1.9 < sampling.sample(years, "id", 2.0, replace=True).count() / years.count() < 2.1


def test_repeated_keys_count_singly(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("id"), F.lit(2001).alias("year"))
    assert sampling.balance_bins(df, "year", "id", n=1001).count() == 1001
    assert sampling.stratified_split(df, "year", "id", 0.5).filter("is_train").count() == 1000


def test_random_pairs_beyond_one_round(spark):
    nodes = spark.range(11).select(F.concat(F.lit("n"), "id").alias("node"))
    pairs = sampling.random_pairs(nodes, "node", 23).collect()
    assert sorted(p.pair_id for p in pairs) == list(range(23))
    assert all(p.source != p.target and p.source and p.target for p in pairs)
    for first in range(0, 20, 5):  # a round uses no node twice
        used = [n for p in pairs if first <= p.pair_id < first + 5 for n in (p.source, p.target)]
        assert len(set(used)) == len(used)
