"""Merkle manifest of a table: nested structs rolled up digit by digit.

Leaves are ranked within their group. The binary digits of the rank are grouped away one after another
inside blocks of 2 ** BLOCK_BITS nodes, each grouping nesting two child structs in their parent, so a block is one
row of bounded size. The roots of the blocks are the nodes of the next layer, until every group has one root; the
roots of the groups make a tree of their own. Proofs go down the same way: a transform over the nested
children gives each its siblings, an explode gives it a row, and what lies above a block comes
to it by grouping both under the block's key, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.operators.ranking import with_rank
from tunegrain.runtime import broadcast_within, materialize

BLOCK_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column | str) -> Column:
    """Lowercase hex sha256 of the parts in a row; null parts count as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column | str]) -> Column:
    return digest(*[field(F.col(c) if isinstance(c, str) else c) for c in columns])


def _rollup(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, n, block, node): blocks of 2 ** bits neighbours of the same tree as nested structs.

    `nodes` holds tree, n (nodes of that tree in this layer), pos and node, a struct with a hash. Levels above a tree's
    root pass it on unchanged. All groupings share the one exchange by tree and block.
    """
    digits = [f"digit{k}" for k in range(bits)]
    rows = nodes.select(
        "tree", "n", F.shiftright("pos", bits).alias("block"), "node",
        *[F.shiftright("pos", k).bitwiseAND(F.lit(1)).cast("int").alias(d) for k, d in enumerate(digits)],
    ).repartition("tree", "block")
    for k in range(bits):
        kids = F.transform(F.array_sort(F.collect_list(F.struct(digits[k], "node"))), lambda kid: kid["node"])
        rows = rows.groupBy("tree", "n", "block", *digits[k + 1:]).agg(kids.alias("kids"))
        both = F.when(F.col("n") > 1 << k, digest(F.transform("kids", lambda kid: kid["hash"]))).otherwise(F.col("kids")[0]["hash"])
        rows = rows.withColumn("node", F.struct(both.alias("hash"), "kids")).drop("kids")
    return rows


def _below(node: Column, n: Column, level: int) -> Column:
    """All nodes at the bottom of a block's `node`, each with the siblings on its way up to it."""
    if not level:
        return F.array(F.struct(node.alias("node"), F.array().cast(PATH).alias("path")))
    kids = node["kids"]

    def siblings(place: Column) -> Column:
        step = F.struct(
            F.when(place == 1, F.get(kids, F.lit(0))["hash"]).alias("before"), F.when(place == 0, F.get(kids, F.lit(1))["hash"]).alias("after")
        )
        return F.when(n > 1 << (level - 1), F.array(step)).otherwise(F.array().cast(PATH))

    def child(kid: Column, place: Column) -> Column:
        return F.transform(
            _below(kid, n, level - 1), lambda x: F.struct(x["node"].alias("node"), F.concat(x["path"], siblings(place)).alias("path"))
        )

    return F.flatten(F.transform(kids, child))


def _layers(nodes: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """Written layers of blocks from the leaves up; in the last one each tree has one block. `most` is the largest n."""
    layers = [materialize(_rollup(nodes, bits), "blocks")]
    while most > 1 << bits:
        most = -(-most >> bits)
        up = layers[-1].select(
            "tree", F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.col("block").alias("pos"),
            F.struct(F.col("node.hash").alias("hash"), F.col("block").alias("pos")).alias("node"),
        )
        layers.append(materialize(_rollup(up, bits), "blocks"))
    return layers


def _meet(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each block with the path and roots above it: both are grouped under (tree, block)."""
    kinds = {f.name: f.dataType for f in [*blocks.schema, *above.schema]}
    names = [c for c in kinds if c not in ("tree", "block")]
    both = blocks.select("tree", "block", *[F.col(c) if c in blocks.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]).unionByName(
        above.select("tree", "block", *[F.col(c) if c in above.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])
    )
    return both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def _proofs(layers: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """(tree, subroot, root, node, path) of every bottom node; `above` has tree, block, subroot, root and the path from the subroot on."""
    for i in reversed(range(len(layers))):
        found = _meet(layers[i], above).select(
            "tree", "subroot", "root", F.col("path").alias("upper"), F.explode(_below(F.col("node"), F.col("n"), bits)).alias("below")
        ).select("tree", "subroot", "root", F.col("below.node").alias("node"), F.concat("below.path", "upper").alias("path"))
        if i:
            above = found.select("tree", F.col("node.pos").alias("block"), "subroot", "root", "path")
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["before"], at, step["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.flatten(F.transform(path, lambda step: F.array(step["before"], step["after"]))))


def build_manifest(rows: DataFrame, group: str, order: str, leaf: str, keep: Sequence[str] = (), bits: int = BLOCK_BITS) -> DataFrame:
    """Per row: `group`, `order`, `leaf` and the columns `keep`, with subroot, root and path (siblings from the leaf to the root).

    Groups are trees of their own in the order of their values (null first, bytewise), rows ascend by `order` (null first); equal ones by
    their leaf, so repeated rows are leaves of their own and the root depends on the rows only. A group with a third of all rows is cut into
    blocks like any other. An empty table gives an empty table. `rows` should be written and narrow: it is read twice.
    """
    names = list(dict.fromkeys([group, order, leaf, *keep]))
    narrow = rows.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)]).withColumn("_copy", F.monotonically_increasing_id())
    g, o, h = (f"_{names.index(c)}" for c in (group, order, leaf))
    ranked = with_rank(narrow, [g, o, h, "_copy"], "_rank")
    trees = materialize(ranked.groupBy(F.col(g).alias("_group")).agg(F.min("_rank").alias("tree"), F.count(F.lit(1)).alias("n")), "trees")
    count, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = ranked.join(broadcast_within(trees, count), F.col(g).eqNullSafe(F.col("_group"))).select(
        "tree", "n", (F.col("_rank") - F.col("tree")).alias("pos"),
        F.struct(F.col(h).alias("hash"), *[F.col(f"_{i}").alias(f"_{i}") for i in range(len(names))]).alias("node"),
    )
    layers = _layers(nodes, most, bits)
    # the trees' own tree, in the order of their first ranks
    roots = with_rank(layers[-1].select("tree", F.col("node.hash").alias("hash")), ["tree"], "turn")
    crown = _layers(
        roots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(count).cast("bigint").alias("n"), F.col("turn").alias("pos"),
                     F.struct("hash", F.col("tree").alias("of")).alias("node")),
        count, bits,
    )
    top = crown[-1].select("tree", "block", F.lit("").alias("subroot"), F.col("node.hash").alias("root"), F.array().cast(PATH).alias("path"))
    above = _proofs(crown, top, bits).select(
        F.col("node.of").alias("tree"), F.lit(0).cast("bigint").alias("block"), F.col("node.hash").alias("subroot"), "root", "path"
    )
    return _proofs(layers, above, bits).select(*[F.col(f"node._{i}").alias(c) for i, c in enumerate(names)], "subroot", "root", "path")


def tampered(doc_id: Column) -> Column:
    """Where 7 divides the unsigned crc32 of the decimal doc_id; never for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def document_proofs(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Manifest of documents, each proven against the root: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    Rows that `tampered` names are checked as if their n_chars were one more (null stays null, and so does what is beyond a long), the others as they are.
    Null, empty and repeated values are hashed as they stand; other columns are not read. Texts are hashed
    in the scan, and only digests are sorted and grouped.
    """
    changed = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf_digest(FIELDS).alias("leaf"), F.when(tampered(F.col("doc_id")), leaf_digest(changed)).alias("other_leaf"))
    proven = build_manifest(materialize(leaves, "leaves"), "lang", "doc_id", "leaf", ["other_leaf"], bits)
    folded = proven.withColumn("folded_root", fold(F.coalesce("other_leaf", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), "path",
    )


def _leaf_sql(n_chars: str) -> str:
    fields = [f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


# crc32 byte by byte and bit by bit; 3988292384 is the reflected polynomial, 4294967295 all bits.
_CRC = """xor(list_reduce(list_transform(range(0, strlen(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::int, 1))::bigint),
    lambda a, c: list_reduce(range(0, 8), lambda b, i: case when b % 2 = 1 then xor(b // 2, 3988292384) else b // 2 end, xor(a, c)),
    4294967295::bigint), 4294967295::bigint)"""

# Levels of the groups' trees (kind 0) and of the tree of their roots (kind 1), siblings level by level, and the fold.
MANIFEST_SQL = f"""
with recursive leaf as materialized (
  select doc_id, lang, {_leaf_sql('n_chars')} as leaf, case when crc % 7 = 0 then {_leaf_sql('(n_chars + 1)')} else {_leaf_sql('n_chars')} end as checked
  from (select *, {_CRC} as crc from documents)
), placed as materialized (
  select *, row_number() over () as id, dense_rank() over (order by lang nulls first) - 1 as g, count(*) over (partition by lang) as n,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaf
), tree as materialized (
  with recursive t as (
    select g, 0 as level, pos, n, leaf as h from placed
    union all select g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by g, level, pos // 2, n
  ) select * from t
), crown as materialized (
  with recursive t as (
    select 0 as level, g as pos, (select max(g) + 1 from placed) as n, h from tree where n = 1
    union all select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by level, pos // 2, n
  ) select * from t
), step as materialized (
  select p.id, t.level, (p.pos >> t.level) % 2 as side, s.h from placed p join (select distinct g, level from tree where n > 1) t on t.g = p.g
    left join tree s on s.g = p.g and s.level = t.level and s.pos = xor(p.pos >> t.level, 1)
  union all
  select p.id, 1000 + t.level, (p.g >> t.level) % 2, s.h from placed p cross join (select distinct level from crown where n > 1) t
    left join crown s on s.level = t.level and s.pos = xor(p.g >> t.level, 1)
), path as materialized (select id, list({{'side': side, 'h': coalesce(h, '')}} order by level) as steps from step group by id)
select p.doc_id, p.leaf, r.h as subroot, c.h as root, sha256(coalesce(list_reduce(list_transform(steps, lambda x: x.h), lambda a, b: a || b, ''), '')) as proof_sha256,
  coalesce(list_reduce(list_transform(steps, lambda x: {{'side': x.side, 'h': x.h}}), lambda a, b: {{'side': b.side, 'h': sha256(case b.side when 1 then b.h || a.h else a.h || b.h end)}},
    {{'side': 0::bigint, 'h': p.checked}}).h, p.checked) as folded_root, folded_root = c.h as verified
from placed p left join path using (id) join (select g, h from tree where n = 1) r on r.g = p.g cross join (select h from crown where n = 1) c
"""
