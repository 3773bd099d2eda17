"""Exact percentiles without a sort of the whole column.

The built-in exact `percentile` keeps every distinct value of a column in one buffer.
Here the wanted ranks of a column lie in brackets, disjoint value ranges. A sketch of all columns
in one pass gives them, a second pass counts what lies below and inside, and a third reads the
ranks off. Only where a bracket is still too large to sort, a pass counts its rows by equal-width
buckets and shrinks it to the buckets that hold a rank. It reads one column at a time and shuffles at most `BUCKETS` counts per bracket
and task. A value that fills a third of the column costs nothing extra: its bracket is done
as soon as its ends are equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
SORT_ROWS = 100_000
SKETCH = 10_000  # the sketch is off by at most rows / SKETCH ranks


@dataclass
class _Bracket:
    column: int
    lo: float
    hi: float
    below: int  # rows of the column before the bracket
    rows: int
    ranks: list[int]  # 1-based ranks in the whole column


def _usable(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _members(df: DataFrame, cols: Sequence[str], brackets: list[_Bracket]) -> DataFrame:
    """(t, v, p): bracket number, value and relative position of every value inside a bracket."""
    scans = []
    for i, name in enumerate(cols):
        mine = [(t, b) for t, b in enumerate(brackets) if b.column == i]
        if not mine:
            continue
        # The outer limits of the brackets are a plain comparison that reaches the file scan.
        lo, hi = min(b.lo for _, b in mine), max(b.hi for _, b in mine)
        values = df.filter(F.col(name).between(lo, hi)).select(_usable(name).alias("v"))
        number = position = F.lit(None)
        for t, b in mine:
            inside = F.col("v").between(F.lit(b.lo), F.lit(b.hi))
            number = F.when(inside, F.lit(t)).otherwise(number)
            # halves first: the difference of two large values may be no number
            share = (F.col("v") / 2 - F.lit(b.lo / 2)) / F.lit(b.hi / 2 - b.lo / 2)
            position = F.when(inside, share).otherwise(position)
        scans.append(values.select(number.alias("t"), "v", position.alias("p")).filter(F.col("t").isNotNull()))
    return reduce(DataFrame.unionAll, scans)


def _wanted(brackets: list[_Bracket]) -> Column:
    """The ranks asked of bracket `t`, counted from its first row."""
    lists = [F.array(*[F.lit(r - b.below).cast("bigint") for r in b.ranks]) for b in brackets]
    return F.get(F.array(*lists), F.col("t"))


def _shrink(df: DataFrame, cols: Sequence[str], brackets: list[_Bracket]) -> list[_Bracket]:
    bucket = F.least(F.floor(F.col("p") * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
    counts = (
        _members(df, cols, brackets)
        .groupBy("t", bucket.alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("b"))
    before = F.col("upto") - F.col("n")
    hit = (
        counts.withColumn("upto", upto)
        .withColumn("rank", F.explode(_wanted(brackets)))
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > before))
        .groupBy("t", "b")
        .agg(*[F.first(c).alias(c) for c in ("lo", "hi", "n", "upto")], F.collect_list("rank").alias("ranks"))
    )
    smaller = []
    for row in hit.collect():  # at most one row per wanted rank
        old = brackets[row["t"]]
        below = old.below + row["upto"] - row["n"]
        ranks = [r + old.below for r in row["ranks"]]
        smaller.append(_Bracket(old.column, row["lo"], row["hi"], below, row["n"], ranks))
    return smaller


def _read_off(df: DataFrame, cols: Sequence[str], brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """Brackets with few rows: sort those rows and take the wanted ones."""
    ordered = _members(df, cols, brackets).withColumn("rn", F.row_number().over(Window.partitionBy("t").orderBy("v")))
    rows = ordered.filter(F.array_contains(_wanted(brackets), F.col("rn").cast("bigint"))).select("t", "rn", "v")
    return {
        (brackets[row["t"]].column, row["rn"] + brackets[row["t"]].below): row["v"] for row in rows.collect()
    }


def _first_brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], stats) -> list[_Bracket]:
    """Brackets around the ranks, from the sketch of the first pass and one pass that counts below and inside them."""
    guesses: list[tuple[int, float, float, list[int]]] = []
    for i in range(len(cols)):
        s = stats[f"c{i}"]
        n, finite = s["n"], s["n"] - s["low"] - s["high"]
        ranks = sorted({r + 1 for prob in probs for r in (math.floor(prob * (n - 1)), math.ceil(prob * (n - 1)))} if n else ())
        ranks = [r for r in ranks if s["low"] < r <= n - s["high"]]
        if not ranks:
            continue
        if finite <= SORT_ROWS or finite < n:
            guesses.append((i, s["lo"], s["hi"], ranks))
            continue
        for k, prob in enumerate(probs):
            own = [r for r in ranks if r - 1 in (math.floor(prob * (n - 1)), math.ceil(prob * (n - 1)))]
            lo, hi = max(s["lo"], s["guess"][2 * k]), min(s["hi"], s["guess"][2 * k + 1])
            last = guesses[-1] if guesses and guesses[-1][0] == i else None
            if last and lo <= last[2]:
                guesses[-1] = (i, min(lo, last[1]), max(hi, last[2]), sorted({*last[3], *own}))
            else:
                guesses.append((i, lo, hi, own))
    if not guesses:
        return []
    counts = df.agg(*[
        F.struct(
            F.count_if(_usable(cols[i]) < lo).alias("below"), F.count_if(_usable(cols[i]).between(lo, hi)).alias("rows")
        ).alias(f"b{k}") for k, (i, lo, hi, _) in enumerate(guesses)
    ]).first()
    brackets = []
    for k, (i, lo, hi, ranks) in enumerate(guesses):
        below, rows = counts[f"b{k}"]
        if all(below < r <= below + rows for r in ranks):
            brackets.append(_Bracket(i, lo, hi, below, rows, ranks))
        else:  # the sketch was off; the whole column is always right
            s = stats[f"c{i}"]
            brackets = [b for b in brackets if b.column != i]
            every = sorted({r for c, _, _, own in guesses if c == i for r in own})
            brackets.append(_Bracket(i, s["lo"], s["hi"], s["low"], s["n"] - s["low"] - s["high"], every))
            guesses = [g for g in guesses if g[0] != i or g[3] == ranks]
    return brackets


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, prob, value) with linear interpolation between neighbouring ranks.

    Null and NaN are left out; infinities are the first and last ranks. A column without any value gets null.
    """
    around = sorted(probs)
    slack = 5 / SKETCH
    guess = F.array(*[F.lit(min(1.0, max(0.0, q))) for prob in around for q in (prob - slack, prob + slack)])
    infinite = float("inf")

    def finite(c):
        return F.when(F.abs(_usable(c)) < infinite, _usable(c))

    stats = df.agg(*[
        F.struct(
            F.count(_usable(c)).alias("n"), F.count_if(_usable(c) == -infinite).alias("low"), F.count_if(_usable(c) == infinite).alias("high"),
            F.min(finite(c)).alias("lo"), F.max(finite(c)).alias("hi"), F.percentile_approx(finite(c), guess, F.lit(SKETCH)).alias("guess"),
        ).alias(f"c{i}") for i, c in enumerate(cols)
    ]).first()
    found: dict[tuple[int, int], float] = {}
    wanted = [(i, prob, prob * (stats[f"c{i}"]["n"] - 1)) for i in range(len(cols)) for prob in probs]
    brackets = _first_brackets(df, cols, around, stats)
    while brackets:
        done = [b for b in brackets if b.lo == b.hi or not b.ranks]
        found.update({(b.column, rank): b.lo for b in done for rank in b.ranks})
        brackets = [b for b in brackets if b.lo < b.hi and b.ranks]
        if not brackets:
            break
        if all(b.rows <= SORT_ROWS for b in brackets):
            found.update(_read_off(df, cols, brackets))
            break
        brackets = _shrink(df, cols, brackets)

    def value_at(i, rank):
        s = stats[f"c{i}"]
        return -infinite if rank <= s["low"] else infinite if rank > s["n"] - s["high"] else found[(i, rank)]

    rows = []
    for i, prob, position in wanted:
        value = None
        if stats[f"c{i}"]["n"]:
            low, part = math.floor(position), position - math.floor(position)
            a, b = value_at(i, low + 1), value_at(i, math.ceil(position) + 1)
            # next to an infinite rank there is nothing to interpolate
            value = a if a == b or not part or math.isinf(a) else b if math.isinf(b) else a + (b - a) * part
        rows.append((cols[i], float(prob), value))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
