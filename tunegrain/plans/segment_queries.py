"""Segment statistics: array form and long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrain.operators import segments
from tunegrain.plans.registry import query, rounded, table

_DIMS = 12
_PAIRS = [(i, j) for i in range(_DIMS) for j in range(i, _DIMS)]
# The 64 values of a vector as four segments of sixteen.
_WIDE = 16
_WIDE_PAIRS = [(i, j) for i in range(_WIDE) for j in range(i, _WIDE)]


def _values(name: str, width: int, parts: list[str]) -> str:
    """(label, pos, value) rows of one aggregate expression per position."""
    assert len(parts) == width
    columns = ", ".join(f"round({p}, 6) as v{k}" for k, p in enumerate(parts))
    listed = ", ".join(f"v{k}" for k in range(width))
    return (
        f"select label, unnest(range(0, {width}))::int as pos, unnest([{listed}]) as value "
        f"from (select label, {columns} from (select label, embedding, unnest(range(0, 4)) as s from embeddings) group by label)"
    )


_MEANS = [f"avg(embedding[s * {_WIDE} + {i + 1}]::double)" for i in range(_WIDE)]
_COVS = [f"covar_samp(embedding[s * {_WIDE} + {i + 1}]::double, embedding[s * {_WIDE} + {j + 1}]::double)" for i, j in _WIDE_PAIRS]


def _segments(spark, d):
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.slice("embedding", s * _WIDE + 1, _WIDE))
    return table(spark, d, "embeddings").select("label", F.explode(cut).alias("segment"))


def _long(df, key, array):
    """One row per element, so that a comparison does not depend on how lists are hashed."""
    return rounded(df.select(key, F.posexplode(array).alias("pos", "value")))


@query("array_stats", """
select vec_id, round(avg(v), 6) as embedding_mean, round(stddev_pop(v), 6) as embedding_std, round(max(v), 6) as embedding_max
from (select vec_id, unnest(embedding)::double as v from embeddings) group by vec_id""")
def array_stats(spark, d):
    return rounded(segments.array_stats(table(spark, d, "embeddings"), ["embedding"], ["vec_id"]))


@query("grouped_stats", "select user_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, "
                        "round(max(value), 6) as max from events group by user_id")
def grouped_stats(spark, d):
    return rounded(segments.grouped_stats(table(spark, d, "events"), "user_id", "value"))


@query("segment_means", _values("means", _WIDE, _MEANS))
def segment_means(spark, d):
    return _long(segments.segment_means(_segments(spark, d), "label", "segment", _WIDE), "label", "means")


@query("segment_covariances", _values("covariances", len(_WIDE_PAIRS), _COVS))
def segment_covariances(spark, d):
    found = segments.segment_covariances(_segments(spark, d), "label", "segment", _WIDE)
    return _long(found, "label", "covariances")


@query("segment_signature", _values("signature", _WIDE + len(_WIDE_PAIRS), _MEANS + _COVS))
def segment_signature(spark, d):
    found = segments.segment_signature(_segments(spark, d), "label", "segment", _WIDE)
    return _long(found, "label", "signature")


@query("array_signature", f"""
with s as (select vec_id, unnest(range(0, 5)) as r, embedding from embeddings),
m as (select vec_id, {', '.join(f'embedding[(r * 12 + {i + 1})::int]::double as d{i}' for i in range(_DIMS))} from s),
a as (select vec_id, [{', '.join(f'avg(d{i})' for i in range(_DIMS))}, {', '.join(f'covar_samp(d{i}, d{j})' for i, j in _PAIRS)}] as v
  from m group by vec_id)
select vec_id, unnest(range(0, 90))::int as pos, round(unnest(v), 6) as value from a""")
def array_signature(spark, d):
    """Every 64-wide vector as a flat matrix of five segments with a ragged tail of four."""
    found = segments.array_signature(table(spark, d, "embeddings"), ["vec_id"], ["embedding"])
    return _long(found, "vec_id", "embedding")


@query("describe_arrays", "select vec_id, len(embedding)::int as embedding_size from embeddings")
def describe_arrays(spark, d):
    return segments.describe_arrays(table(spark, d, "embeddings"), ["vec_id"], ["embedding"])
