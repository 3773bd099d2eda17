"""Splitting, sampling and balancing by keyed hash.

All exact selections ("the first r rows of each group in hash order") go through
`hash_cut`, which finds the hash of the r-th row from counts. No group is ever sorted
whole, so a bin or class with a third of all rows is selected from like any other.
`key` must identify a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.functions import years
from tunegrain.functions.hashing import HASH_BITS, fraction_cut, key_hash
from tunegrain.operators.ranking import with_rank
from tunegrain.runtime import materialize

_BUCKET_BITS = 16
_ORDERED_ROWS = 100_000  # rows of a group's bucket that are ordered, at most, unless they share a hash
_RUN_COPIES = 1_000
# Eras, their targets and the least quota of a bin.
ERA_EDGES = [1924, 1950, 1970, 1990, 2010]
ERA_TARGETS = [2000, 1500, 1000, 500]
ERA_FLOOR = 50


def split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a row's side depends on its key only."""
    left = key_hash(key, seed) < fraction_cut(fraction)
    return df.filter(left), df.filter(~left)


def sample(df: DataFrame, key: str, fraction: float, replace: bool = False, seed: int = 42) -> DataFrame:
    """Bernoulli sample, or Poisson sample with replacement (`replica` numbers a row's copies).

    A row's draw is the hash of its key, so the same rows come out of any partition layout. With
    replacement a row comes as often as the Poisson distribution's inverse says for its draw.
    """
    draw = key_hash(key, seed)
    if not replace:
        return df.filter(draw < fraction_cut(fraction))
    copies = F.lit(0)
    for cut in poisson_cuts(fraction):
        copies = copies + (draw >= cut).cast("int")
    times = df.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return times.select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("replica"))


def poisson_cuts(mean: float) -> list[int]:
    """Hash values from which on a row comes once, twice, ...; later ones lie beyond the hash's range."""
    cuts, term, total, k = [], math.exp(-mean), math.exp(-mean), 0
    while (cut := int(total * 2**HASH_BITS)) < 2**HASH_BITS and term > 0:
        cuts.append(cut)
        k += 1
        term *= mean / k
        total += term
    return cuts


def _join_groups(df: DataFrame, per_group: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-group table on its group columns; a null group is a group like any other."""
    names = {g: f"_of_{g}" for g in groups}
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(name)) for g, name in names.items()])
    return df.join(per_group.withColumnsRenamed(names), same, how).drop(*names.values())


def hash_cut(hashed: DataFrame, groups: Sequence[str], key: str, rank: Column) -> DataFrame:
    """(groups, _rows, _cut_h, _cut_key, _over): where the first `rank` rows of a group end in (hash, key) order.

    `hashed` has the key's hash as `_h`. `rank` may use the group columns and `_rows`, the size of the group. The cut is null for
    rank 0. `_over` is the number of rows with the cut's key that lie behind it: 0 unless keys repeat.
    One pass counts the groups' hash buckets; the bucket of a group that holds the rank is counted again by
    its next bits until it has few rows, and only those are ordered. Results are written, so that a
    join against them is planned from their measured size.
    """
    groups = list(groups)
    by_group = Window.partitionBy(*groups)
    tagged = hashed.select(*groups, F.col(key).alias("_k"), "_h")
    shift, wanted = HASH_BITS, None
    while True:
        shift = max(0, shift - _BUCKET_BITS)
        bucket = F.shiftright(F.col("_h"), shift)
        rows = tagged if wanted is None else _join_groups(tagged, wanted.select(*groups, "_cut_b", "_shift"), groups).filter(
            F.shiftright(F.col("_h"), shift + _BUCKET_BITS) == F.col("_cut_b")
        ).drop("_cut_b", "_shift")
        counts = rows.groupBy(*groups, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        upto = counts.withColumn("_upto", F.sum("_n").over(by_group.orderBy("_b")))
        if wanted is None:
            upto = upto.withColumn("_rows", F.sum("_n").over(by_group)).withColumn("_rank", rank)
        else:
            upto = _join_groups(upto, wanted.select(*groups, "_rows", F.col("_within").alias("_rank")), groups)
        holds = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        profile = upto.groupBy(*groups).agg(
            F.first("_rows").alias("_rows"),
            F.max(F.when(holds, F.col("_b"))).alias("_cut_b"),
            F.max(F.when(holds, F.col("_rank") - F.col("_upto") + F.col("_n"))).alias("_within"),
            F.max(F.when(holds, F.col("_n"))).alias("_held"),
        ).withColumn("_shift", F.lit(shift))
        wanted = materialize(profile, "profile")
        largest = wanted.agg(F.max("_held")).first()[0] or 0
        if shift == 0 or largest <= _ORDERED_ROWS:
            break
    edge = _join_groups(tagged, wanted, groups).filter(F.shiftright(F.col("_h"), shift) == F.col("_cut_b"))
    # copies of a key are counted, not ordered one by one
    keys = edge.groupBy(*groups, "_h", "_k").agg(F.count(F.lit(1)).alias("_n"), F.first("_within").alias("_within"))
    ordered = keys.withColumn("_upto", F.sum("_n").over(by_group.orderBy("_h", "_k")))
    last = (F.col("_upto") >= F.col("_within")) & (F.col("_upto") - F.col("_n") < F.col("_within"))
    cuts = ordered.filter(last).select(
        *groups, F.col("_h").alias("_cut_h"), F.col("_k").alias("_cut_key"), (F.col("_upto") - F.col("_within")).alias("_over")
    )
    return materialize(_join_groups(wanted.select(*groups, "_rows"), cuts, groups, "left"), "cuts")


def _before_cut(key: str) -> Column:
    hash_col, cut = F.col("_h"), F.col("_cut_h")
    inside = (hash_col < cut) | ((hash_col == cut) & (F.col(key) <= F.col("_cut_key")))
    return F.coalesce(inside, F.lit(False))


def _marked(hashed: DataFrame, cuts: DataFrame, groups: Sequence[str], key: str, name: str) -> DataFrame:
    """`hashed` with the cuts joined and `name`: whether a row is among the first of its group.

    Where the cut falls between copies of one key, the copies are numbered, and only as many as fit count.
    """
    joined = _join_groups(hashed, cuts, groups).withColumn(name, _before_cut(key))
    if cuts.filter(F.col("_over") > 0).isEmpty():
        return joined
    split_key = (F.col("_over") > 0) & (F.col("_h") == F.col("_cut_h")) & (F.col(key) == F.col("_cut_key"))
    at = F.coalesce(split_key, F.lit(False))
    copies = with_rank(joined.filter(at), [*groups], "_copy")
    first = copies.groupBy(*groups).agg(F.min("_copy").alias("_first"), F.max("_copy").alias("_last"))
    numbered = _join_groups(copies, first, groups)
    cut_copies = numbered.withColumn(name, F.col("_copy") + F.col("_over") <= F.col("_last")).drop("_copy", "_first", "_last")
    return joined.filter(~at).unionByName(cut_copies)


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    """Adds `is_train`: exactly round(fraction * size) rows of every class are true."""
    hashed = df.withColumn("_h", key_hash(key, seed))
    rank = F.round(F.col("_rows") * F.lit(fraction)).cast("bigint")
    cuts = hash_cut(hashed, [label], key, rank)
    return _marked(hashed, cuts, [label], key, "is_train").select(*df.columns, "is_train")


def _balance(binned: DataFrame, groups: Sequence[str], quota: Column, key: str, seed: int) -> DataFrame:
    """Exactly `quota` rows per group: every row quota // size times, the first quota % size once more."""
    hashed = binned.withColumn("_h", key_hash(key, seed))
    cuts = hash_cut(hashed, groups, key, quota % F.col("_rows"))
    joined = _marked(hashed, cuts, groups, key, "_more")
    copies = F.floor(quota / F.col("_rows")).cast("int") + F.col("_more").cast("int")
    kept = joined.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    # a row's copies are spread over runs first, so no row ever holds one long array
    runs = kept.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _RUN_COPIES).cast("int"))))
    start = F.col("_run") * _RUN_COPIES
    replica = F.explode(F.sequence(start, F.least(start + _RUN_COPIES, F.col("_copies")) - 1))
    spread = runs.select(*binned.columns, replica.alias("replica"))
    return spread.withColumn("replica", F.col("replica").cast("int"))


def balance_bins(
    df: DataFrame, col: str, key: str, lo: int = 1924, hi: int = 2011, width: int = 5, n: int = 1000,
    merge_outside: bool = False, seed: int = 42,
) -> DataFrame:
    """Adds `bin` and `replica`: every non-empty year bin comes out with exactly `n` rows.

    Full bins are sampled without replacement, short ones repeat their rows as evenly as
    possible. Rows without a year are left out.
    """
    index = years.bin_index(F.col(col), lo, hi, width, merge_outside)
    binned = df.filter(F.col(col).isNotNull()).withColumn("bin", index)
    return _balance(binned, ["bin"], F.lit(n), key, seed)


def era_quota(edges: Sequence[int], targets: Sequence[int], width: int, floor: int) -> list[int]:
    """Rows per bin of each era: its target spread evenly over its bins, but at least `floor`."""
    bins = [len(years.bin_edges(lo, hi, width)) - 1 for lo, hi in zip(edges, edges[1:])]
    return [max(floor, target // count) for target, count in zip(targets, bins)]


def balance_eras(
    df: DataFrame, col: str, key: str, edges: Sequence[int] = ERA_EDGES, targets: Sequence[int] = ERA_TARGETS,
    width: int = 5, floor: int = ERA_FLOOR, seed: int = 42,
) -> DataFrame:
    """Adds `era`, `bin` (within the era) and `replica`; years outside the eras are left out."""
    year = F.col(col)
    era = F.lit(None).cast("int")
    start = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (year >= lo) & (year < hi)
        era, start = F.when(inside, F.lit(i)).otherwise(era), F.when(inside, F.lit(lo)).otherwise(start)
    binned = (
        df.filter((year >= edges[0]) & (year < edges[-1]))
        .withColumn("era", era)
        .withColumn("bin", F.floor((year - start) / width).cast("int"))
    )
    quotas = era_quota(edges, targets, width, floor)
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("era") + 1)
    return _balance(binned, ["era", "bin"], quota, key, seed)


def random_pairs(nodes: DataFrame, node: str, n: int, seed: int = 42) -> DataFrame:
    """(pair_id, source, target): `n` pairs of different nodes, reproducible from the seed.

    Nodes are drawn in hash order and taken two by two. When fewer than 2n exist they are
    drawn again under further hashes. Rounds are ranked by one range-partitioned sort; in the last
    round only nodes below a hash that surely holds enough are ordered.
    """
    distinct = materialize(nodes.select(F.col(node).alias("_node")).filter(F.col(node).isNotNull()).distinct(), "nodes")
    available = distinct.count()
    if available < 2:
        raise ValueError("two different nodes are needed for a pair")
    per_round = available // 2
    rounds = -(-n // per_round)
    drawn = distinct.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = drawn.withColumn("_h", key_hash(F.concat_ws("/", F.col("_round"), F.col("_node")), seed))
    last = 2 * (n - (rounds - 1) * per_round)
    share = (last + 10 * math.sqrt(last) + 10) / available
    if share < 1:
        enough = (F.col("_round") < rounds - 1) | (F.col("_h") < fraction_cut(share))
        if drawn.filter(enough & (F.col("_round") == rounds - 1)).count() >= last:
            drawn = drawn.filter(enough)
    # every earlier round holds all nodes, so a place in the round follows from the rank
    ranked = with_rank(drawn, ["_round", "_h", "_node"], "_rank").withColumn("_r", F.col("_rank") - F.col("_round") * available)
    slot = F.col("_round") * per_round + F.floor(F.col("_r") / 2)
    return (
        ranked.filter(F.col("_r") < 2 * per_round)
        .withColumn("pair_id", slot.cast("bigint"))
        .filter(F.col("pair_id") < n)
        .groupBy("pair_id")
        .agg(
            F.max(F.when(F.col("_r") % 2 == 0, F.col("_node"))).alias("source"),
            F.max(F.when(F.col("_r") % 2 == 1, F.col("_node"))).alias("target"),
        )
    )
