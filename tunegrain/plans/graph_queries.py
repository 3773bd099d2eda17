"""Artist distance over the key graph nation - customer - order - part - supplier - nation."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from tunegrain.operators import graph, sampling
from tunegrain.plans.registry import query, table


def edges(spark, d):
    """(target, similar): one directed edge per key reference; a line gives two."""

    def edge(kind_a, a, kind_b, b):
        return F.struct(
            F.concat(F.lit(kind_a), F.col(a)).alias("target"), F.concat(F.lit(kind_b), F.col(b)).alias("similar")
        )

    customers = table(spark, d, "customer").select(F.inline(F.array(edge("N", "c_nationkey", "C", "c_custkey"))))
    orders = table(spark, d, "orders").select(F.inline(F.array(edge("C", "o_custkey", "O", "o_orderkey"))))
    lines = table(spark, d, "lineitem").select(
        F.inline(F.array(edge("O", "l_orderkey", "P", "l_partkey"), edge("P", "l_partkey", "S", "l_suppkey")))
    )
    suppliers = table(spark, d, "supplier").select(F.inline(F.array(edge("S", "s_suppkey", "N", "s_nationkey"))))
    return customers.unionByName(orders).unionByName(lines).unionByName(suppliers)


_NODES = [
    ("region", "R", "r_regionkey"), ("nation", "N", "n_nationkey"), ("customer", "C", "c_custkey"),
    ("supplier", "S", "s_suppkey"), ("part", "P", "p_partkey"), ("orders", "O", "o_orderkey"),
]


def artists(spark, d, kinds="RNCSPO"):
    """(artist_id); regions have no edge and stay isolated."""
    result = None
    for name, kind, key in _NODES:
        if kind in kinds:
            rows = table(spark, d, name).select(F.concat(F.lit(kind), F.col(key)).alias("artist_id"))
            result = rows if result is None else result.unionByName(rows)
    return result


def _nodes_sql(kinds: str) -> str:
    parts = [f"select '{kind}' || {key} as artist_id from {name}" for name, kind, key in _NODES if kind in kinds]
    return " union all ".join(parts)


_EDGES = """
raw as (select 'N' || c_nationkey as src, 'C' || c_custkey as dst from customer
  union all select 'C' || o_custkey, 'O' || o_orderkey from orders
  union all select 'O' || l_orderkey, 'P' || l_partkey from lineitem
  union all select 'P' || l_partkey, 'S' || l_suppkey from lineitem
  union all select 'S' || s_suppkey, 'N' || s_nationkey from supplier),
edge as materialized (select src, dst, count(*) as copies from raw group by 1, 2)"""

# Levels, smallest backpointers and hits for the sources listed in `starts`.
_SEARCH = """
walk(source, node, dist) as (select source, source, 0 from starts
  union select w.source, e.dst, w.dist + 1 from walk w join edge e on e.src = w.node where w.dist < 10),
d as materialized (select source, node, min(dist) as dist from walk group by 1, 2),
step as materialized (select p.source, e.dst as node, p.dist + 1 as dist, p.node as src, e.copies
  from d p join edge e on e.src = p.node),
into_node as materialized (select source, node, min(src) as backpointer, sum(copies)::bigint as hits
  from step semi join d using (source, node, dist) group by 1, 2),
reached as materialized (select d.source, d.node, d.dist::int as dist, i.backpointer, coalesce(i.hits, 0)::bigint as hits
  from d left join into_node i on i.source = d.source and i.node = d.node)"""


@query("load_graph", f"with {_EDGES}, a as ({_nodes_sql('RNCSPO')}) select a.artist_id, count(raw.dst) as neighbours "
                     f"from a left join raw on raw.src = a.artist_id group by 1")
def load_graph(spark, d):
    loaded = graph.load_graph(artists(spark, d), edges(spark, d))
    return loaded.groupBy("artist_id").agg(F.count("similar").alias("neighbours"))


@query("init_nodes", f"select artist_id as node, case when artist_id = 'N0' then 0 end::int as dist "
                     f"from ({_nodes_sql('RNCSPO')})")
def init_nodes(spark, d):
    return graph.init_nodes(artists(spark, d), "N0")


@query("adjacency", f"""
with {_EDGES}, a as ({_nodes_sql('RNCSPO')}),
k as (select src, dst, (row_number() over (partition by src order by dst) - 1) // 50 as part from raw)
select a.artist_id, coalesce(k.part, 0)::int as part, count(k.dst) as n_similar,
  coalesce(string_agg(k.dst, ',' order by k.dst), '') as similar_artists
from a left join k on k.src = a.artist_id group by 1, 2""")
def adjacency(spark, d):
    """Parts of fifty neighbours, so that long lists are split at every scale."""
    return graph.adjacency(artists(spark, d), edges(spark, d), list_rows=50)


@lru_cache(maxsize=4)
def _laid_out(spark, application: str, d: str):
    return graph.lay_out(edges(spark, d), both=True)


def layout(spark, d):
    """The edges of folder `d`, laid out by the first search of an application and used by all."""
    return _laid_out(spark, spark.sparkContext.applicationId, d)


@query("bfs_levels", f"with recursive {_EDGES}, starts as (select 'N0' as source), {_SEARCH} "
                     f"select node, dist, backpointer, hits from reached")
def bfs_levels(spark, d):
    return graph.bfs_levels(layout(spark, d), "N0")


_PATH = """
trace as (select r.source, r.node as target, r.node as here, [r.node] as path from reached r
    join asked on asked.source = r.source and asked.target = r.node
  union all select t.source, t.target, r.backpointer, list_prepend(r.backpointer, t.path) from trace t
    join reached r on r.source = t.source and r.node = t.here where r.backpointer is not null)
select asked.source, asked.target, r.dist is not null as found, r.dist as distance, coalesce(r.hits, 0)::bigint as hits,
  coalesce(array_to_string(t.path, ' -> '), '') as path
from asked left join reached r on r.source = asked.source and r.node = asked.target
  left join trace t on t.source = asked.source and t.target = asked.target and t.here = asked.source"""

_PAIRS = f"""
drawn as (select artist_id, row_number() over (order by
    ('0x' || substr(md5('0/' || artist_id || ':42'), 1, 15))::bigint, artist_id) - 1 as r from ({_nodes_sql('RNCSPO')})),
pairs as (select r // 2 as pair_id, max(case when r % 2 = 0 then artist_id end) as source,
    max(case when r % 2 = 1 then artist_id end) as target from drawn where r < 16 group by 1)"""


def _shown(paths):
    return paths.withColumn("path", F.coalesce(F.concat_ws(" -> ", "path"), F.lit("")))


@query("shortest_path", f"with recursive {_EDGES}, starts as (select 'C1' as source), "
                        f"asked as (select 'C1' as source, 'S7' as target), {_SEARCH}, {_PATH}")
def shortest_path(spark, d):
    return _shown(graph.shortest_path(layout(spark, d), "C1", "S7"))


@query("shortest_paths", f"""
with recursive {_EDGES}, {_PAIRS},
asked as (select source, target from pairs union select 'N0', 'R0' union select 'C1', 'C1' union select 'X', 'C1'),
starts as (select distinct source from asked), {_SEARCH}, {_PATH}""")
def shortest_paths(spark, d):
    drawn = sampling.random_pairs(artists(spark, d), "artist_id", 8).select("source", "target")
    fixed = spark.createDataFrame([("N0", "R0"), ("C1", "C1"), ("X", "C1")], ["source", "target"])
    return _shown(graph.shortest_paths(layout(spark, d), drawn.unionByName(fixed)))


_MANY = f"""
a as (select artist_id from ({_nodes_sql('RNCSPO')})), n as (select count(*) // 2 as per from a),
drawn as (select artist_id, t, row_number() over (partition by t order by
    ('0x' || substr(md5(t || '/' || artist_id || ':42'), 1, 15))::bigint, artist_id) - 1 as r from a, (select unnest(range(0, 2)) as t)),
pairs as (select t * per + r // 2 as pair_id, max(case when r % 2 = 0 then artist_id end) as source,
    max(case when r % 2 = 1 then artist_id end) as target from drawn, n where r < 2 * per group by 1)"""


@query("random_pairs", f"with {_MANY} select pair_id, source, target from pairs where pair_id < (select per from n) + 100")
def random_pairs(spark, d):
    """A hundred more pairs than one round over all artists gives."""
    nodes = artists(spark, d)
    return sampling.random_pairs(nodes, "artist_id", nodes.count() // 2 + 100)


@query("first_per_key", """
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts, event_id) as rn
  from events) where rn = 1""")
def first_per_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return graph.first_per_key(rows, "user_id", ["ts", "event_id"]).drop("ts")
