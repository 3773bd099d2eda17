"""Artist distance: bounded breadth-first search over directed similarity edges."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from math import prod
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.operators.layout import Layout, Side, lay_out
from tunegrain.operators.ranking import with_rank
from tunegrain.runtime import materialize

MAX_DEPTH = 10
BATCH_PAIRS = 1024  # pairs that a search advances together: 16 numbers of 64 bits for each node
LIST_ROWS = 100_000  # neighbours in one row of an adjacency list


def load_graph(artists: DataFrame, similarity: DataFrame) -> DataFrame:
    """(artist_id, similar): edges by artist, with one null row for an artist without any.

    The left join is put together from an inner and an anti join: adaptive execution can split
    an artist with very many edges in an inner join, but not on the optional side of a left join.
    """
    edges = similarity.select(F.col("target").alias("artist_id"), "similar")
    connected = artists.select("artist_id").join(edges, "artist_id")
    isolated = artists.select("artist_id").join(edges.select("artist_id").distinct(), "artist_id", "left_anti")
    return connected.unionByName(isolated.withColumn("similar", F.lit(None).cast(edges.schema["similar"].dataType)))


def init_nodes(artists: DataFrame, source: Any) -> DataFrame:
    """(node, dist): 0 for the source, null for every artist not reached yet."""
    return artists.select(
        F.col("artist_id").alias("node"), F.when(F.col("artist_id") == F.lit(source), F.lit(0)).alias("dist")
    )


def adjacency(artists: DataFrame, similarity: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(artist_id, part, n_similar, similar_artists): comma-joined, sorted neighbours of every artist.

    The k-th neighbour of an artist stands in part k // list_rows, so that no task ever holds an
    unbounded list, and the parts in order are the whole sorted list. Isolated artists have an
    empty part 0.
    """
    edges = similarity.select("target", F.col("similar").cast("string")).filter(F.col("similar").isNotNull())
    # copies of an edge are spread by their place, so one repeated edge is no hot range
    salted = edges.withColumn("_salt", F.monotonically_increasing_id())
    ranked = with_rank(salted, ["target", "similar", "_salt"], "_rank")
    first = ranked.groupBy("target").agg(F.min("_rank").alias("_first"))
    part = F.floor((F.col("_rank") - F.col("_first")) / list_rows).cast("int")
    lists = ranked.join(first, "target").groupBy("target", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_similar"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_rank", "similar"))), lambda e: e["similar"])).alias("similar_artists"),
    )
    return artists.join(lists, artists["artist_id"] == lists["target"], "left").select(
        "artist_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("n_similar", F.lit(0)).cast("bigint").alias("n_similar"),
        F.coalesce("similar_artists", F.lit("")).alias("similar_artists"),
    )


def _next_level(frontier: DataFrame, side: Side, reached: DataFrame) -> DataFrame:
    """(node, backpointer, hits): neighbours of `frontier` not in `reached`, their smallest predecessor and the edges into them.

    Edges and `reached` stay in their buckets; only partial sums for each node are shuffled.
    """
    arrived = side.step(frontier).groupBy(F.col("far").alias("node")).agg(
        F.min("near").alias("backpointer"), F.sum("copies").alias("hits")
    )
    return arrived.join(reached.select("node").hint("shuffle_hash"), "node", "left_anti")


def bfs_levels(
    edges: DataFrame | Layout, source: Any, max_depth: int = MAX_DEPTH, state_dir: str | None = None
) -> DataFrame:
    """(node, dist, backpointer, hits) of everything within `max_depth` edges of `source`, one job per level.

    `edges` is a table (target, similar) or what `lay_out` made of one. Equal paths are settled by the smallest backpointer;
    `hits` counts the edges into a node from the level before, with copies. With `state_dir` the levels are also kept there, one folder
    for each dist; levels of an earlier search in it are removed.
    """
    layout = edges if isinstance(edges, Layout) else lay_out(edges)
    spark = layout.spark
    wanted = F.lit(source).cast(layout.node_type)
    at = layout.names.filter(F.col("name") == wanted).select("id").head()
    if at is None:
        levels = None
        found = spark.range(1).select(
            wanted.alias("node"), F.lit(None).cast(layout.node_type).alias("backpointer"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("dist")
        )
    else:
        levels = layout.levels()
        levels.append(spark.range(1).select(
            F.lit(at[0]).alias("node"), F.lit(None).cast("long").alias("backpointer"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("dist")
        ))
        for depth in range(max_depth):
            frontier = levels.read().filter(F.col("dist") == depth).select("node")
            levels.append(_next_level(frontier, layout.forward, levels.read()).withColumn("dist", F.lit(depth + 1)))
            # The written level is asked rather than an Observation: a session that has had one can no
            # longer ship binary logistic models, whose summary holds the session.
            if levels.read().filter(F.col("dist") == depth + 1).isEmpty():
                break
        found = layout.named(layout.named(levels.files(), "node"), "backpointer")
        levels.close()
    if state_dir is not None:
        kept = found.select(F.lit(source).cast(layout.node_type).alias("source"), "node", "backpointer", "hits", "dist")
        kept.write.option("partitionOverwriteMode", "static").partitionBy("dist").parquet(state_dir, mode="overwrite")
        found = spark.read.schema(kept.schema).parquet(state_dir)
    return found.select("node", "dist", "backpointer", "hits")


class _Bitmaps:
    """One side of a search for up to 64 * `words` pairs at once: a node has one row per level, with a bit for each pair."""

    def __init__(self, layout: Layout, side: Side, words: int, start: DataFrame):
        self.side, self.columns, self.depth = side, [f"b{i}" for i in range(words)], 0
        self.levels = layout.levels()
        self._append(start.groupBy("node").agg(*[F.bit_or(c).alias(c) for c in self.columns]))

    def _append(self, rows: DataFrame) -> None:
        self.levels.append(rows.select("node", *self.columns).withColumn("dist", F.lit(self.depth)))

    def level(self, dist: int) -> DataFrame:
        return self.levels.read().filter(F.col("dist") == dist).drop("dist")

    def advance(self, pending: list[int]) -> bool:
        """One level further for the pairs in `pending`; False if nothing new was reached."""
        left = {c: F.col(c).bitwiseAND(F.lit(mask)).alias(c) for c, mask in zip(self.columns, pending)}
        frontier = _any_bit(self.level(self.depth).select("node", *left.values()), self.columns)
        arrived = self.side.step(frontier).groupBy(F.col("far").alias("node")).agg(*[F.bit_or(c).alias(c) for c in self.columns])
        seen = self.levels.read().groupBy("node").agg(*[F.bit_or(c).alias(f"seen_{c}") for c in self.columns])
        new = arrived.join(seen.hint("shuffle_hash"), "node", "left").select(
            "node", *[F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"seen_{c}", F.lit(0).cast("long")))).alias(c) for c in self.columns]
        )
        self.depth += 1
        self._append(_any_bit(new, self.columns))
        return not self.level(self.depth).isEmpty()

    def holding(self, dist: int) -> DataFrame:
        """(at, word bits): nodes of a level under a name that joins with other tables."""
        return self.level(dist).select(F.col("node").alias("at"), F.array(*self.columns).alias("bits"))


def _any_bit(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter(reduce(or_, [F.col(c) != 0 for c in columns]))


def _has_bit(bits: str, pair: str) -> Column:
    return F.expr(f"shiftright({bits}[cast(shiftright({pair}, 6) as int)], cast({pair} & 63 as int)) & 1 = 1")


def _pairs_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(node, pair) for every bit that is set."""
    words = rows.select("node", F.posexplode(F.array(*columns)).alias("word", "bits")).filter("bits <> 0")
    return words.select("node", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1)")).alias("bit"), "word").select(
        "node", (F.col("word").cast("long") * 64 + F.col("bit")).alias("pair")
    )


def _search_batch(layout: Layout, pairs: DataFrame, count: int, max_depth: int) -> DataFrame:
    """(pair, distance, hits, path) of the pairs (pair: 0 to count - 1, source, target: node numbers) that have a path; path as node numbers.

    Both sides advance in turn, so each goes at most half of the way. Where they meet, the nodes
    on shortest paths are followed: to the target along the edges into what the backward levels hold, and from the target back by
    smallest predecessors. Only these nodes have a row for each pair.
    """
    words = -(-count // 64)

    def start(end: str) -> DataFrame:
        bit = F.expr("shiftleft(1L, cast(pair & 63 as int))")
        columns = [F.when(F.shiftright("pair", 6) == i, bit).otherwise(F.lit(0).cast("long")).alias(f"b{i}") for i in range(words)]
        return pairs.select(F.col(end).alias("node"), *columns)

    ahead, behind = _Bitmaps(layout, layout.forward, words, start("source")), _Bitmaps(layout, layout.backward, words, start("target"))
    columns = ahead.columns
    pending = [-1 if 64 * (i + 1) <= count else (1 << count % 64) - 1 for i in range(words)]
    meetings: list[DataFrame] = []
    steps: list[tuple[int, int]] = []
    while True:
        other = behind.level(behind.depth).select("node", *[F.col(c).alias(f"o_{c}") for c in columns])
        both = ahead.level(ahead.depth).join(other, "node").select(
            "node", *[F.col(c).bitwiseAND(F.col(f"o_{c}")).bitwiseAND(F.lit(mask)).alias(c) for c, mask in zip(columns, pending)]
        )
        bits = both.agg(*[F.bit_or(c) for c in columns]).first()
        if any(bits):
            met = _pairs_of(_any_bit(both, columns), columns)
            meetings.append(materialize(met.withColumn("forth", F.lit(ahead.depth)).withColumn("back", F.lit(behind.depth)), "met"))
            steps.append((ahead.depth, behind.depth))
            pending = [mask & ~(b or 0) for mask, b in zip(pending, bits)]
        if not any(pending) or ahead.depth + behind.depth == max_depth:
            break
        if not (ahead if ahead.depth <= behind.depth else behind).advance(pending):
            break
    if not meetings:
        return layout.spark.createDataFrame([], "pair long, distance int, hits long, path array<long>")
    meet = reduce(DataFrame.unionByName, meetings)
    # to the target: rows (pair, node) with `back` levels to go, and each one's smallest predecessor and edges into it
    toward: dict[int, DataFrame] = {}
    on_path = None
    for back in range(max(b for _, b in steps), 0, -1):
        here = meet.filter(F.col("back") == back).select("pair", "node")
        here = here if on_path is None else here.unionByName(on_path.select("pair", "node"))
        moved = layout.forward.step(here, 64 * words).join(behind.holding(back - 1), F.col("far") == F.col("at")).filter(_has_bit("bits", "pair"))
        on_path = materialize(
            moved.groupBy("pair", F.col("far").alias("node")).agg(F.min("near").alias("before"), F.sum("copies").alias("into")), "on-path"
        )
        toward[back - 1] = on_path
    lengths = meet.groupBy("pair").agg(F.min("forth").alias("forth"), F.min("back").alias("back"))
    walk = pairs.join(lengths, "pair").select(
        "pair", "forth", "back", F.col("target").alias("node"), F.array("target").alias("path"), F.lit(0).cast("long").alias("hits")
    )
    walk = materialize(walk, "walk")

    def walked(walk: DataFrame, step: DataFrame) -> DataFrame:
        """One node further back; `step` has pair, before and into. The edges into the target are its hits."""
        joined = walk.join(step, "pair", "left")
        hits = F.when(F.size("path") == 1, F.coalesce("into", "hits")).otherwise(F.col("hits"))
        return joined.select(
            "pair", "forth", "back", F.coalesce("before", "node").alias("node"), hits.alias("hits"),
            F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat(F.array("before"), F.col("path"))).alias("path"),
        )

    for back in sorted(toward):
        step = walk.select("pair", "node").join(toward[back], ["pair", "node"]).select("pair", "before", "into")
        walk = materialize(walked(walk, step), "walk")
    for forth in range(max(f for f, _ in steps), 0, -1):
        here = walk.filter(F.col("forth") >= forth).select("pair", "node")
        moved = layout.backward.step(here, 64 * words).join(ahead.holding(forth - 1), F.col("far") == F.col("at")).filter(_has_bit("bits", "pair"))
        step = moved.groupBy("pair").agg(F.min("far").alias("before"), F.sum("copies").alias("into"))
        walk = materialize(walked(walk, step), "walk")
    ahead.levels.close()
    behind.levels.close()
    return walk.select("pair", (F.col("forth") + F.col("back")).alias("distance"), "hits", "path")


def shortest_paths(
    edges: DataFrame | Layout, pairs: DataFrame, max_depth: int = MAX_DEPTH, batch: int = BATCH_PAIRS
) -> DataFrame:
    """(source, target, found, distance, hits, path) for every pair (source, target).

    `edges` is a table (target, similar) or what `lay_out(edges, both=True)` made of one. `batch` pairs advance together, from both ends;
    a level holds one row for each node, whatever the number of pairs. Equal-length paths are settled by the smallest
    backpointer; `hits` counts the edges into the target from the last level, with copies. A pair of equal ends has distance 0.
    """
    layout = edges if isinstance(edges, Layout) else lay_out(edges, both=True)
    if layout.turned is None:
        raise ValueError("shortest paths need a layout of both directions")
    spark, kind = layout.spark, layout.node_type
    asked = pairs.select(F.col("source").cast(kind), F.col("target").cast(kind)).distinct()
    names = layout.names
    known = asked.join(names.select(F.col("name").alias("source"), F.col("id").alias("_s")), "source").join(
        names.select(F.col("name").alias("target"), F.col("id").alias("_t")), "target"
    )
    numbered = with_rank(known, ["source", "target"], "_pair")
    asked, total = materialize(asked, "asked"), numbered.count()
    found = []
    for first in range(0, total, batch):
        size = min(batch, total - first)
        part = numbered.filter(F.col("_pair").between(first, first + size - 1))
        part = materialize(part.select((F.col("_pair") - first).alias("pair"), F.col("_s").alias("source"), F.col("_t").alias("target")), "pairs")
        found.append(_search_batch(layout, part, size, max_depth).withColumn("_pair", F.col("pair") + first).drop("pair"))
    schema = "_pair long, distance int, hits long, path array<long>"
    paths = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    nodes = paths.select("_pair", "distance", "hits", F.posexplode("path").alias("_place", "_node"))
    listed = layout.named(nodes, "_node").groupBy("_pair", "distance", "hits").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "_node"))), lambda x: x["_node"]).alias("path")
    )
    ends = numbered.select("_pair", F.col("source").alias("_source"), F.col("target").alias("_target"))
    named = listed.join(ends, "_pair").select("_source", "_target", "distance", "hits", "path")
    same = F.col("source") == F.col("target")
    return asked.join(named, (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target")), "left").select(
        "source", "target", (F.col("distance").isNotNull() | F.coalesce(same, F.lit(False))).alias("found"),
        F.coalesce("distance", F.when(same, F.lit(0))).alias("distance"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce("path", F.when(same, F.array("source"))).alias("path"),
    )


def shortest_path(edges: DataFrame | Layout, source: Any, target: Any, max_depth: int = MAX_DEPTH) -> DataFrame:
    spark = edges.spark if isinstance(edges, Layout) else edges.sparkSession
    return shortest_paths(edges, spark.createDataFrame([(source, target)], ["source", "target"]), max_depth)


def _order_code(df: DataFrame, order: Sequence[str]) -> Column | None:
    """`order` as one whole number that sorts alike (nulls first), or None if a column is no whole number, date or time, or the ranges are too wide."""
    kinds = dict(df.dtypes)
    numbers = []
    for c in order:
        if kinds[c] in ("tinyint", "smallint", "int", "bigint", "boolean"):
            numbers.append(F.col(c).cast("bigint"))
        elif kinds[c] == "date":
            numbers.append(F.unix_date(c).cast("bigint"))
        elif kinds[c] in ("timestamp", "timestamp_ntz"):
            numbers.append(F.unix_micros(F.col(c).cast("timestamp")))
        else:
            return None
    ends = df.agg(*[f(n) for n in numbers for f in (F.min, F.max)]).first()
    lows = [ends[2 * i] or 0 for i in range(len(numbers))]
    radices = [(ends[2 * i + 1] or 0) - low + 2 for i, low in enumerate(lows)]
    if prod(radices) >= 10**38:
        return None
    kind = "bigint" if prod(radices) < 1 << 63 else "decimal(38,0)"
    code = F.lit(0).cast(kind)
    for number, low, radix in zip(numbers, lows, radices):
        # the lowest place is for null
        place = F.coalesce(number.cast("decimal(20,0)") - F.lit(Decimal(low - 1)).cast("decimal(20,0)"), F.lit(0)).cast(kind)
        code = (code * F.lit(Decimal(radix)).cast(kind) + place).cast(kind)
    return code


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in `order` (nulls first); of equal rows in that order, one.

    Partial minima keep a hot key out of the shuffle. Whole numbers, dates and times are packed into one number of fixed width, so the
    minimum is found by hashing; other orders are compared as structs, which takes a sort. Rows are found again by key and order.
    """
    others = [c for c in df.columns if c != key]
    code = _order_code(df, order)
    if code is not None:
        coded = df.withColumn("_code", code)
        best = coded.groupBy(F.col(key).alias("_key")).agg(F.min("_code").alias("_least"))
        found = coded.join(best, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_code") == F.col("_least")), "left_semi")
        return found.dropDuplicates([key, "_code"]).select(key, *others)
    names = {c: f"_first_{c}" for c in (key, *order)}
    best = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_best")).select(
        F.col(key).alias(names[key]), *[F.col(f"_best.{c}").alias(names[c]) for c in order]
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    found = df.join(best, same, "left_semi")
    return found.dropDuplicates([key, *order]).select(key, *others)
