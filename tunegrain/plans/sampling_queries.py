"""Splits and balanced samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrain.functions.hashing import HASH_BITS, fraction_cut
from tunegrain.operators import sampling
from tunegrain.plans.registry import ORDER_YEARS_SQL, hash_sql, order_years, query, table


@query("key_split", f"select song_id, {hash_sql('song_id')} < {fraction_cut(0.8)} as is_train from {ORDER_YEARS_SQL}")
def key_split(spark, d):
    train, test = sampling.split(order_years(spark, d), "song_id", 0.8)
    return train.select("song_id", F.lit(True).alias("is_train")).unionByName(
        test.select("song_id", F.lit(False).alias("is_train"))
    )


@query("stratified_split", f"""
select vec_id, label, row_number() over (partition by label order by {hash_sql('vec_id')}, vec_id)
  <= floor(0.8 * count(*) over (partition by label) + 0.5) as is_train from embeddings""")
def stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.8)


def _balance_sql(groups: str, quota: str, binned: str) -> str:
    """Repeat the rows of each group in full rounds and keep the first `quota` in hash order."""
    return f"""
with b as (select *, {hash_sql('song_id')} as h from {binned}),
c as (select {groups}, count(*) as c from b group by {groups}),
r as (select b.*, {quota} as n, unnest(range(0, ceil({quota} * 1.0 / c.c)::int)) as replica from b join c using ({groups})),
k as (select *, row_number() over (partition by {groups} order by replica, h, song_id) as rn from r)
select song_id, year, {groups}, replica::int as replica from k where rn <= n"""


@query("balance_bins", _balance_sql("bin", "3000", f"""
(select song_id, year, case when year < 1996 then -1 when year >= 2000 then 2 else (year - 1996) // 2 end::int as bin
 from {ORDER_YEARS_SQL} where year is not null)"""))
def balance_bins(spark, d):
    """Two two-year bins, and the years before and after them; at sf0.01 the years before are too few."""
    songs = order_years(spark, d).select("song_id", "year")
    return sampling.balance_bins(songs, "year", "song_id", lo=1996, hi=2000, width=2, n=3000)


@query("balance_eras", _balance_sql("era, bin", "(case era when 0 then 4000 when 1 then 1000 else 4500 end)", f"""
(select song_id, year, case when year < 1997 then 0 when year < 2000 then 1 else 2 end::int as era,
  (year - case when year < 1997 then 1995 when year < 2000 then 1997 else 2000 end)::int as bin
 from {ORDER_YEARS_SQL} where year >= 1995 and year < 2002)"""))
def balance_eras(spark, d):
    songs = order_years(spark, d).select("song_id", "year")
    return sampling.balance_eras(
        songs, "year", "song_id", edges=[1995, 1997, 2000, 2002], targets=[8000, 3000, 9000], width=1
    )


_POISSON = sampling.poisson_cuts(0.3)


@query("sample_share", f"""
with h as (select song_id, {hash_sql('song_id')} as h from {ORDER_YEARS_SQL}),
c as (select song_id, {' + '.join(f'(h >= {cut})::int' for cut in _POISSON)} as copies from h)
select 'bernoulli' as kind, song_id, 0 as replica from h where h < {fraction_cut(0.1)}
union all select 'poisson', song_id, unnest(range(0, copies))::int from c""")
def sample_share(spark, d):
    """The rows drawn by a tenth without, and three tenths with replacement."""
    orders = order_years(spark, d).select("song_id")
    plain = sampling.sample(orders, "song_id", 0.1).select(F.lit("bernoulli").alias("kind"), "song_id", F.lit(0).alias("replica"))
    again = sampling.sample(orders, "song_id", 0.3, replace=True)
    return plain.unionByName(again.select(F.lit("poisson").alias("kind"), "song_id", "replica"))


@query("hash_spread", f"""
select ({hash_sql('song_id')} >> {HASH_BITS - 3})::int as octant, count(*) as n from {ORDER_YEARS_SQL} group by 1""")
def hash_spread(spark, d):
    """How evenly the keyed hash fills the eighths of its range."""
    from tunegrain.functions.hashing import key_hash

    octant = F.shiftright(key_hash("song_id", 42), HASH_BITS - 3).cast("int")
    return order_years(spark, d).groupBy(octant.alias("octant")).agg(F.count(F.lit(1)).alias("n"))
