from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunegrain.operators import graph, sampling
from tunegrain.sources import graph as sources


def edges(spark, text):
    pairs = [tuple(p.split(">")) for p in text.split()]
    return spark.createDataFrame(pairs, "target string, similar string")


CHAIN = " ".join(f"n{i}>n{i + 1}" for i in range(11))

CASES = [
    ("direct", "A>B", "A", "B", (True, 1, 1, ["A", "B"])),
    ("tie", "A>C A>D C>B D>B", "A", "B", (True, 2, 2, ["A", "C", "B"])),
    ("duplicate edge", "A>B A>B", "A", "B", (True, 1, 2, ["A", "B"])),
    ("cycle", "A>C C>A C>B", "A", "B", (True, 2, 1, ["A", "C", "B"])),
    ("direction", "B>A", "A", "B", (False, None, 0, None)),
    ("isolated", "A>B", "A", "D", (False, None, 0, None)),
    ("dangling", "A>Z", "A", "Z", (True, 1, 1, ["A", "Z"])),
    ("same", "A>B B>A", "A", "A", (True, 0, 0, ["A"])),
    ("unknown source", "A>B", "X", "B", (False, None, 0, None)),
    ("ten levels", CHAIN, "n0", "n10", (True, 10, 1, [f"n{i}" for i in range(11)])),
    ("eleven levels", CHAIN, "n0", "n11", (False, None, 0, None)),
]


def test_shortest_paths_of_all_cases_at_once(spark):
    """Every case lives in its own part of one graph, its nodes prefixed with the case number."""
    graphs, pairs = [], []
    for i, (_, text, source, target, _) in enumerate(CASES):
        graphs.append(" ".join(">".join(f"{i}/{n}" for n in e.split(">")) for e in text.split()))
        pairs.append((f"{i}/{source}", f"{i}/{target}"))
    asked = spark.createDataFrame(pairs, "source string, target string")
    rows = {(r.source, r.target): r for r in graph.shortest_paths(edges(spark, " ".join(graphs)), asked).collect()}
    for i, (name, _, _, _, expected) in enumerate(CASES):
        row = rows[pairs[i]]
        path = row.path and [n.split("/", 1)[1] for n in row.path]
        assert (row.found, row.distance, row.hits, path) == expected, name


def test_searches_share_a_layout_and_hubs_stay_out_of_the_buckets(spark):
    """Random graph with two hubs, more pairs than bits of a number: against a plain search in Python."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(7, i) for i in range(60)] + [(i, 9) for i in range(0, 60, 2)] + [(7, 8)] * 3
    rows += [(None, 3), (3, None)]
    laid = graph.lay_out(spark.createDataFrame(rows, "target int, similar int"), both=True, buckets=4, hub_edges=20)
    assert laid.forward.hub_count == 1 and laid.backward.hub_count == 1
    copies = Counter((a, b) for a, b in rows if a is not None and b is not None)
    into = {}
    for (a, b), n in copies.items():
        into.setdefault(b, {})[a] = n

    def plain(a, b, most=6):
        dist, frontier = {a: 0}, [a]
        for d in range(1, most + 1):
            frontier = sorted({t for s, t in copies if s in set(frontier)} - dist.keys())
            dist.update((n, d) for n in frontier)
        if b not in dist:
            return False, None, 0, None
        path, hits = [b], 0
        while path[0] != a:
            before = {s: n for s, n in into[path[0]].items() if dist.get(s) == dist[path[0]] - 1}
            hits = hits or sum(before.values())
            path.insert(0, min(before))
        return True, dist[b], hits, path

    pairs = [(a, b) for a in range(0, 60, 4) for b in range(1, 60, 6)] + [(99, 99), (99, 1), (1, 99), (7, 7)]
    asked = spark.createDataFrame(pairs, "source int, target int")
    found = {(r.source, r.target): (r.found, r.distance, r.hits, r.path) for r in graph.shortest_paths(laid, asked, 6, batch=70).collect()}
    assert found == {p: (True, 0, 0, [p[0]]) if p[0] == p[1] else plain(*p) for p in pairs}
    levels = {r.node: (r.dist, r.backpointer) for r in graph.bfs_levels(laid, 7, 6).collect()}
    assert levels == {b: (plain(7, b)[1], (plain(7, b)[3][-2:-1] or [None])[0]) for b in range(60) if plain(7, b)[0]}


def test_a_level_moves_neither_edges_nor_what_was_reached(spark):
    pairs = spark.range(3000).select((F.col("id") % 100).cast("string").alias("target"), (F.col("id") * 7 % 997).cast("string").alias("similar"))
    laid = graph.lay_out(pairs)
    levels = laid.levels()
    levels.append(spark.createDataFrame([(3, None, 0, 0)], "node long, backpointer long, hits long, dist int"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frontier = levels.read().filter(F.col("dist") == 0).select("node")
        plan = graph._next_level(frontier, laid.forward, levels.read())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    levels.close()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "HashAggregate" in plan
    # three scans in buckets: the frontier and the edges below the one exchange of partial sums, what was reached beside it
    below = plan[plan.index("Exchange"):]
    assert plan.count("Bucketed: true") == 3 and below.count("Bucketed: true") == 3 - plan[: plan.index("Exchange")].count("Bucketed: true")


def test_a_level_hashes_its_frontier_and_sorts_no_edges(spark):
    laid = graph.lay_out(spark.range(3000).select((F.col("id") % 100).alias("target"), (F.col("id") * 7 % 997).alias("similar")), both=True)
    assert "backward" not in vars(laid)  # laid out by the first search that needs it
    levels = laid.levels()
    levels.append(spark.createDataFrame([(3, None, 0, 0)], "node long, backpointer long, hits long, dist int"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frontier = levels.read().filter(F.col("dist") == 0).select("node")
        plan = graph._next_level(frontier, laid.forward, levels.read())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    levels.close()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
    assert laid.backward.edges.count() == laid.forward.edges.count()


def test_shortest_path(spark):
    row = graph.shortest_path(edges(spark, "A>C A>D C>B D>B B>E"), "A", "B").first()
    assert (row.found, row.distance, row.hits, row.path) == (True, 2, 2, ["A", "C", "B"])


def test_levels_grow_by_one_per_edge_and_repartition_changes_nothing(spark):
    pairs = spark.range(400).select(
        (F.col("id") % 40).alias("target"), ((F.col("id") * 7 + F.floor(F.col("id") / 40)) % 97).alias("similar")
    )
    found = {r.node: r for r in graph.bfs_levels(pairs, 0).collect()}
    again = {r.node: r for r in graph.bfs_levels(pairs.repartition(7), 0).collect()}
    assert found == again and found[0].dist == 0
    for r in pairs.collect():
        if r.target in found and found[r.target].dist < 10:
            assert found[r.similar].dist <= found[r.target].dist + 1
    for r in found.values():
        if r.dist:
            assert found[r.backpointer].dist == r.dist - 1


def test_state_folder_keeps_levels_and_is_wiped_first(spark, tmp_path):
    folder = str(tmp_path / "levels")
    graph.bfs_levels(edges(spark, "A>B B>C C>D D>E"), "A", state_dir=folder).collect()
    assert (tmp_path / "levels" / "dist=4").exists()
    rows = graph.bfs_levels(edges(spark, "A>B"), "A", state_dir=folder).collect()
    assert {r.node for r in rows} == {"A", "B"}
    assert not (tmp_path / "levels" / "dist=4").exists()


def test_hot_artist_is_split_over_parts_without_loss(spark):
    hot = spark.range(1000).select(F.lit("H").alias("target"), F.concat(F.lit("s"), F.col("id")).alias("similar"))
    copies = spark.range(500).select(F.lit("K").alias("target"), F.lit("same").alias("similar"))
    few = edges(spark, "A>C A>B")
    artists = spark.createDataFrame([("H",), ("K",), ("A",), ("D",)], "artist_id string")
    rows = graph.adjacency(artists, hot.unionByName(copies).unionByName(few), list_rows=100).collect()
    by_artist = {}
    for r in rows:
        by_artist.setdefault(r.artist_id, []).append(r)
    assert [(r.part, r.n_similar, r.similar_artists) for r in by_artist["A"]] == [(0, 2, "B,C")]
    assert [(r.n_similar, r.similar_artists) for r in by_artist["D"]] == [(0, "")]
    parts = sorted(by_artist["H"], key=lambda r: r.part)
    assert [(r.part, r.n_similar) for r in parts] == [(i, 100) for i in range(10)]
    assert ",".join(r.similar_artists for r in parts) == ",".join(sorted(f"s{i}" for i in range(1000)))
    assert sum(r.n_similar for r in by_artist["K"]) == 500
    assert sum(len(r.similar_artists.split(",")) for r in by_artist["K"]) == 500
    assert len(by_artist["K"]) > 1


def test_adjacency_text(spark, tmp_path):
    (tmp_path / "adjacency.txt").write_text("A\tB,C\nB\t\nC\nD\tA\n")
    rows = sources.read_adjacency_text(spark, str(tmp_path / "adjacency.txt")).collect()
    assert sorted((r.target, r.similar or "") for r in rows) == [
        ("A", "B"), ("A", "C"), ("B", ""), ("C", ""), ("D", "A")
    ]


def test_jdbc_options():
    options = sources.jdbc_options("jdbc:x:y", "similarity", "id", 0, 10, 4, driver="d")
    assert options == {
        "url": "jdbc:x:y", "dbtable": "similarity", "driver": "d", "partitionColumn": "id", "lowerBound": "0",
        "upperBound": "10", "numPartitions": "4",
    }
    with pytest.raises(ValueError):
        sources.jdbc_options("u", "t", "id")


def test_load_graph_keeps_isolated_artists(spark):
    artists = spark.createDataFrame([("A",), ("D",)], "artist_id string")
    rows = graph.load_graph(artists, edges(spark, "A>B A>C")).collect()
    assert sorted((r.artist_id, r.similar or "") for r in rows) == [("A", "B"), ("A", "C"), ("D", "")]


def test_random_pairs(spark):
    nodes = spark.range(50).select(F.col("id").cast("string").alias("artist_id"))
    pairs = sampling.random_pairs(nodes, "artist_id", 20)
    rows = pairs.collect()
    assert len(rows) == 20 and all(r.source != r.target for r in rows)
    assert sorted(rows) == sorted(sampling.random_pairs(nodes.repartition(5), "artist_id", 20).collect())
    many = sampling.random_pairs(nodes, "artist_id", 60).collect()
    assert len(many) == 60 and all(r.source != r.target for r in many)
    with pytest.raises(ValueError):
        sampling.random_pairs(nodes.limit(1), "artist_id", 1)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, graph.first_per_key(df, "k", ["o"]).collect())) == [("a", 1, "y"), ("b", 5, "z")]
