"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Every window of an item (13 words in a row, or the whole of a shorter item) is a set of
3-word shingles at fixed places. Occurrences of item shingles in documents are found in one pass
over the texts. A document that contains a window contains its rarest shingle, so
only that one is joined; places outside the document are cut off by position and length,
and what remains is verified shingle by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm.columns import unused
from tunegrain.runtime import broadcast_within, materialize

WINDOW = 13
SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; null gives none."""
    column = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def _shingles(words: str, size: int) -> Column:
    """All runs of `size` words, in order."""
    def joined(i):
        return F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(size)])

    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), joined)).otherwise(
        F.array().cast("array<string>")
    )


def _entry(size: int):
    return lambda shingle, i: F.struct(F.lit(size).alias("size"), i.alias("pos"), shingle.alias("shingle"))


def _windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as (wid, place, size, shingle, length), and which items hold them (wid, item_id)."""
    words = items.select("item_id", words_of("text").alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = words.withColumn("length", length).select(
        "item_id", "length", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")), lambda i: F.slice("w", i + 1, F.col("length")))).alias("words")
    )
    cut = cut.withColumn("wid", F.sha2(F.concat_ws(" ", "words"), 256))
    holders = cut.select("wid", "item_id").distinct()
    single = cut.select("wid", "length", "words").dropDuplicates(["wid"])
    parts = None
    for size in range(1, SHINGLE + 1):
        own = single.filter(F.col("length") == size if size < SHINGLE else F.col("length") >= size)
        part = own.select("wid", "length", F.lit(size).alias("size"), F.posexplode(_shingles("words", size)).alias("place", "shingle"))
        parts = part if parts is None else parts.unionByName(part)
    return parts, holders


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where item windows occur.

    Returns rows (row, doc_id, text_hash, n_words) for every row of `docs`, occurrences (row, wid,
    start, length) in words, and holders (wid, item_id). Null texts and items have no words.
    """
    parts, holders = _windows(items, window)
    parts, holders = materialize(parts, "windows"), materialize(holders, "holders")
    wanted = materialize(parts.select("size", "shingle").distinct(), "wanted")
    sizes = [r["size"] for r in parts.select("size").distinct().collect()]
    texts = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words_of("text").alias("w")
    ).withColumn("row", F.monotonically_increasing_id())
    # the entry without a shingle keeps every row in the one pass over the texts
    entries = F.concat(
        F.array(F.struct(F.lit(0).alias("size"), F.lit(-1).alias("pos"), F.lit("").alias("shingle"))),
        *[
            F.transform(_shingles("w", size), _entry(size)) for size in sorted(sizes)
        ],
    )
    spread = texts.select("row", "doc_id", "text_hash", F.size("w").alias("n_words"), F.inline(entries))
    mark = docs.sparkSession.range(1).select(F.lit(0).alias("size"), F.lit("").alias("shingle"))
    keys = broadcast_within(wanted.unionByName(mark), wanted.count() + 1)
    found = materialize(spread.join(keys, ["size", "shingle"]), "shingles")
    rows = found.filter("size = 0").select("row", "doc_id", "text_hash", "n_words")
    hits = found.filter("size > 0")

    rarity = hits.groupBy("size", "shingle").agg(F.count("*").alias("often"))
    # a window with a shingle that no document has cannot occur
    ranked = parts.join(rarity, ["size", "shingle"], "left").groupBy("wid", "length").agg(
        F.min_by(F.struct("size", "shingle", "place"), F.struct(F.coalesce("often", F.lit(0)).alias("o"), "place")).alias("p"),
        F.min(F.coalesce("often", F.lit(0))).alias("least"), F.count("*").alias("shingles"),
    ).filter("least > 0")
    prefix = materialize(ranked.select("wid", "length", "shingles", "p.size", "p.shingle", "p.place"), "prefixes")
    windows = broadcast_within(prefix, prefix.count())
    candidates = hits.join(windows, ["size", "shingle"]).withColumn("start", F.col("pos") - F.col("place")).filter(
        "start >= 0 and start + length <= n_words"
    ).select("row", "wid", "start", "length", "shingles")
    needed = candidates.join(broadcast_within(parts.drop("length"), parts.count()), "wid").withColumn("pos", F.col("start") + F.col("place"))
    places = hits.select("row", "pos", "size", "shingle")
    whole = (
        needed.join(places, ["row", "pos", "size", "shingle"]).groupBy("row", "wid", "start", "length", "shingles")
        .agg(F.count("*").alias("n")).filter("n = shingles")
    )
    return rows, materialize(whole.select("row", "wid", "start", "length"), "occurrences"), holders


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of every row of `docs`.

    A word inside any occurrence is hit; a document is contaminated from one word in twenty on. Repeated
    rows and doc_ids are judged row by row; an item_id that is null is not listed.
    """
    rows, occurrences, holders = find_windows(docs, items, window)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    end = (F.col("start") + F.col("length")).alias("end")
    covered = (
        occurrences.select("row", "start", end).distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
        .groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    named = occurrences.select("row", "wid").distinct().join(holders, "wid").filter("item_id is not null").select(
        "row", F.col("item_id").cast("string").alias("item")
    ).distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    out = rows.join(covered, "row", "left").join(named, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all columns, that are not contaminated."""
    id_, hash_ = unused(docs, "bad_id", "bad_hash")
    bad = contamination(docs, items, window).filter("contaminated").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    bad = materialize(bad.distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_))
    return docs.join(broadcast_within(bad, bad.count()), same, "left_anti")


CONTAMINATION_SQL = r"""
with item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), win as (
  select item_id, least(13, len(w)) as k, unnest(range(0, len(w) - least(13, len(w)) + 1)) as s, w from item where len(w) > 0
), wanted as (
  select distinct item_id, k, array_to_string(w[s + 1 : s + k], ' ') as t from win
), doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), place as (
  select r, k, unnest(range(0, len(w) - k + 1)) as p, w from doc, (select distinct k from wanted) where len(w) >= k
), hit as (
  select r, p, wanted.k, item_id from place join wanted on wanted.k = place.k and wanted.t = array_to_string(w[p + 1 : p + place.k], ' ')
), covered as (
  select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from hit) group by r
), named as (
  select r, count(*) as n_items, string_agg(i, ',' order by i) as items
  from (select distinct r, item_id::varchar as i from hit where item_id is not null) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join covered using (r) left join named using (r)
"""
