"""Near-duplicates by bottom-k sketches from one hash function.

Texts with equal shingle sets form one class; only classes are compared. A class keeps the k
smallest shingle hashes. Inverted lists of kept values, rarest first, find pairs: two
linked sets share so many kept values (`least_shared`, but for odds below MISS) that one of the few rarest is common, so a passage that is found in very many
texts is not listed unless it makes up about half a text. Each list is compared with its head, the
member with the fewest values of its own; the union sketch filters pairs, the full sets decide.
Lists that still hold several components are then built again from full sets, where no odds are
left, compared with their heads, and at last among the classes of different components.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm.columns import unused
from tunegrain.llm.components import components
from tunegrain.llm.encode import text_slices
from tunegrain.llm.shingles import Shingler
from tunegrain.runtime import broadcast_within, materialize

SKETCH = 64
MISS = 1e-7  # odds that a pair at the threshold shares fewer kept values than `least_shared`
BITS = [f"w{i}" for i in range(16)]  # words of a set's bitmap
CELL = 2_048  # members of a list that meet in one group, about


def least_shared(percent: int) -> int:
    """The kept values that two sets at the threshold share but for odds of MISS: each is common with odds of percent / 100 (28 of 64 at 75)."""
    share, tail = percent / 100, 0.0
    for shared in range(SKETCH + 1):
        tail += comb(SKETCH, shared) * share**shared * (1 - share) ** (SKETCH - shared)
        if tail >= MISS:
            return max(1, shared)
    return SKETCH


def _key(values: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(values.astype("<u8").tobytes())
    first, second = np.frombuffer(digest, "<i8").tolist()
    return first, second


def _signatures(docs: DataFrame) -> DataFrame:
    def work(batches):
        shingler = Shingler()
        for part, texts in text_slices(batches):
            sets = shingler.sets(texts)
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()), pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        work, f"doc_id {kind}, text_hash long, n_shingles long, k1 long, k2 long, sketch array<bigint>"
    )


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words per set; each value sets one bit."""
    bits = np.zeros((len(sets), 64 * len(BITS)), np.uint8)
    for row, values in zip(bits, sets):
        row[(values % np.uint64(len(row))).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """`node` and `set` of the classes in `nodes`, read again from one text of each."""
    wanted = materialize(nodes.distinct().join(classes.select("node", "first", "k1", "k2"), "node"), "wanted")
    wanted = broadcast_within(wanted, wanted.count())
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("first")))

    def work(batches):
        shingler = Shingler()
        for part, texts in text_slices(batches):
            sets = shingler.sets(texts)
            k1, k2 = part.column("k1").to_pylist(), part.column("k2").to_pylist()
            own = [i for i, s in enumerate(sets) if _key(s) == (k1[i], k2[i])]  # a doc_id may have other texts, too
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node").take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64())),
                    *(pa.array(column) for column in _bitmaps([sets[i] for i in own]).T),
                ], names=["node", "set", *BITS],
            )

    schema = "node long, set array<bigint>, " + ", ".join(f"{c} long" for c in BITS)
    sets = texts.select("node", "k1", "k2", "text").mapInArrow(work, schema)
    return materialize(sets.dropDuplicates(["node"]), "sets")


def _unsigned(value):
    """Order of the hashes as unsigned numbers, on signed ones."""
    return value.bitwiseXOR(F.lit(-(2**63)))


def _alike_sketches(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sizes and union sketches allow the similarity."""
    sketches = classes.select("node", "sketch", "n")
    near = (
        pairs.join(sketches.toDF("b", "sb", "nb"), "b").join(sketches.toDF("a", "sa", "na"), "a")
        .filter((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    )
    lowest = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), _unsigned)), 1, SKETCH)
    both = F.size(F.array_intersect(F.transform(F.array_intersect("sa", "sb"), _unsigned), lowest))
    return materialize(near.filter(both * SKETCH >= least_shared(percent) * F.size(lowest)).select("a", "b"), "pairs")


def _alike_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets have the similarity."""
    common = F.size(F.array_intersect("x", "y"))
    return materialize(
        pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        .filter(common * 100 >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links",
    )


def _prefixes(values: DataFrame, least: Column) -> DataFrame:
    """The rarest values of each node that any partner must share one of: value, node, n, single, rank.

    `values` has value, node, n (set size) and s (values kept). Values of a single node count
    as its rarest (`single` of them) but make no list; `least` is the number that partners share.
    """
    often = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    window = Window.partitionBy("node")
    return (
        values.join(often, "value").withColumn("single", F.col("s") - F.count("*").over(window))
        .withColumn("rank", F.row_number().over(window.orderBy("df", "value")))
        .filter(F.col("rank") + F.col("single") <= F.col("s") - least + 1)
        .select("value", "node", "n", "single", "rank")
    )


def _heads(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's head, the member with the fewest values of its own, with the others."""
    head = lists.groupBy("value").agg(F.min(F.struct("single", "node"))["node"].alias("a"))
    return lists.join(head, "value").filter("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _labelled(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components so far, and the lists that still hold several of them."""
    found = components(links)
    known = lists.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = known.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("value")
    return found, materialize(known.join(split, "value"), "lists")


def _with_partner(members: DataFrame, percent: int) -> DataFrame:
    """The `members` (value, n, most) of lists with some member of a size that their own values allow, and `upto`, the largest such size.

    Common values are at most `most`, so a partner has no more than `upto` values. Members are counted by bands of
    sizes; partners are at most one band apart. Templates whose texts differ by own values end here, in linear time.
    """
    members = members.withColumn("upto", F.expr(f"most * {100 + percent} div {percent} - n"))
    members = members.withColumn("band", F.floor(F.log("n") / log(101 / percent)))
    sizes = members.groupBy("value", "band").agg(F.min("n").alias("lo"), F.max("upto").alias("hi"))
    near = sizes.select("value", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "lo", "hi")
    near = materialize(near.groupBy("value", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "sizes")
    found = members.join(broadcast_within(near, near.count()), ["value", "band"]).filter("upto >= lo and n <= hi")
    return materialize(found.drop("band", "lo", "hi"), "members")


def _cell_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one list, but of different components, that bounds do not rule out.

    A list is dealt into cells of about CELL members by hash, and every two cells meet in a group of their own, so
    a hot list is spread over many tasks.
    """
    cells = members.groupBy("value").count().filter("count > 1")
    cells = materialize(cells.select("value", F.ceil(F.col("count") / CELL).cast("int").alias("cells")), "cells")
    dealt = members.join(broadcast_within(cells, cells.count()), "value").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("cells") - 1))).drop("own", "cells")
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).drop("own", "cells")
    key = ["value", "i", "j"]
    right = right.select(*[c if c in key else F.col(c).alias(f"{c}_b") for c in right.columns])
    # Both sets less their own values bound what is common, and so do the bits that differ, since each
    # comes from a value of one side only. A pair is taken from its first common list.
    differ = " + ".join(f"bit_count({c} ^ {c}_b)" for c in BITS)
    return left.join(right, key).filter(
        "(i < j or node < node_b) and component <> component_b and n_b <= upto and n <= upto_b "
        f"and (n + n_b - ({differ})) * (100 + {percent}) >= 2 * {percent} * (n + n_b) "
        "and get(array_intersect(prefix, prefix_b), 0) = value"
    ).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row, and the text_hash of its component's first row (`stands`)."""
    rows = materialize(_signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = rows.filter("n_shingles > 0")
    members = some.groupBy("k1", "k2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.count("*").alias("copies"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("stands"),
    )
    classes = materialize(members, "classes")

    kept = F.size("sketch")
    # Up to that size sets and all their partners are kept whole, so the share is exact.
    whole = F.col("n") <= SKETCH * percent // 100
    least = F.when(whole, F.ceil(F.col("s") * percent / 100)).otherwise(F.ceil(F.col("s") * least_shared(percent) / SKETCH))
    values = classes.select("node", "n", kept.alias("s"), F.explode("sketch").alias("value"))
    lists = materialize(_prefixes(values, least), "prefixes")
    near = _alike_sketches(_heads(lists), classes, percent)
    sets = _full_sets(docs, classes, near.select(F.col("a").alias("node")).union(near.select("b")))
    links = _alike_sets(near, sets, percent)
    _, left = _labelled(lists, links)

    # What is not connected through a head is compared again by whole sets: only members of lists with
    # several components can still gain a link, so counts among them suffice.
    sets = _full_sets(docs, classes, left.select("node"))
    values = sets.select("node", F.size("set").alias("n"), F.size("set").alias("s"), F.explode("set").alias("value"))
    lists = materialize(_prefixes(values, F.ceil(F.col("n") * percent / 100)), "prefixes")
    links = materialize(links.union(_alike_sets(_heads(lists), sets, percent)), "links")
    found, left = _labelled(lists, links)
    first = left.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("prefix"))
    left = left.join(first, "node").join(sets.drop("set"), "node").select(
        "value", "node", "n", "component", "prefix", (F.col("n") - F.col("single")).alias("most"), *BITS
    )
    rest = _cell_pairs(_with_partner(left, percent), percent)
    more = _alike_sets(materialize(rest, "pairs"), sets, percent)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    label = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = materialize(label.select("k1", "k2", "component", "first", "stands"), "labels")
    names = label.groupBy("component").agg(F.min("first").alias("component_id"), F.min("stands")["text_hash"].alias("stands"))
    named = label.drop("stands").join(names, "component").select("k1", "k2", "component_id", "stands")
    return (
        rows.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "text_hash", "n_shingles", "component_id", "stands")
    )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Two texts are linked if 100 * common >= percent * union of their distinct 5-word shingles.
    Null and empty texts have no shingles and no links. A row without a doc_id takes part, but names no
    component, unless the component has no other name. Rows with the same doc_id are judged by their texts.
    """
    return _judged(docs, percent).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of `docs`, with all columns, that stand for their group; equal rows become one.

    A group's smallest doc_id stays, with one text if several of the group have that doc_id. Rows with the same doc_id
    are judged by their texts. Rows without a doc_id stay.
    """
    stands = (F.col("n_shingles") == 0) | ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("stands")))
    found = materialize(_judged(docs, percent).dropna(subset=["doc_id"]).select("doc_id", "text_hash", stands.alias("kept")), "kept")
    gone = found.filter("not kept").select("doc_id", "text_hash").distinct()
    id_, hash_ = unused(docs, "gone", "gone_hash")
    gone = broadcast_within(gone, gone.count()).toDF(id_, hash_)
    left = docs.join(gone, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left_anti")
    # only repeated ids need a shuffle of texts
    repeated = not found.filter("kept").groupBy("doc_id").count().filter("count > 1").isEmpty()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


NEAR_DUPLICATES_SQL = r"""
with recursive word as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingle as materialized (
  select distinct r, s from (select r, unnest(case
    when len(w) >= 5 then list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from word)
), size as (select r, count(*) as n from shingle group by r),
pair as (select a.r as a, b.r as b, count(*) as k from shingle a join shingle b on a.s = b.s and a.r < b.r group by 1, 2),
link as materialized (
  select a, b from pair join size x on x.r = a join size y on y.r = b where 100 * k >= 75 * (x.n + y.n - k)
), arc as (select a, b from link union all select b, a from link),
reach as (select r, r as t from word union select reach.r, arc.b from reach join arc on reach.t = arc.a),
named as (select reach.r, min(word.doc_id) as component_id from reach join word on word.r = reach.t group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept
from word join named using (r) left join size using (r)
"""
