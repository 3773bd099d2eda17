"""Removal of byte strings that start in an earlier document, by suffix arrays over shards.

A string of 50 bytes is found wherever it stands by the anchor in it: the 16 bytes of least hash. Anchors
are dealt by hash. Occurrences whose whole surroundings (all strings around that anchor) are
equal to those in a smaller document, by a 64-bit hash of them and another of the anchor, are repeats as
they stand. Other surroundings can only share a string if they agree in the half before or the half behind
the anchor; of those the smallest document's text is fetched, shards of them are suffix-sorted by
induction, and neighbours in the array that agree in 50 bytes, by 64-bit range hashes, give the remaining repeats.
Surroundings of an anchor that stands in very many texts are dealt to several shards; each reduces its array to one row
for each different string, the smallest document of all shards is found for every string, and its other members repeat it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm.encode import text_slices
from tunegrain.llm.fingerprints import mix
from tunegrain.llm.suffixes import RangeHashes, repeated_windows, window_groups
from tunegrain.runtime import BROADCAST_ROWS, broadcast_within, materialize

LENGTH = 50
GRAM = 16
BLOCK_ANCHORS = 600_000  # anchors that a task gathers before it deals them out
BUCKET_BYTES = 2_000_000  # text bytes whose anchors share a bucket and a suffix array, about
PART_PIECES = 2048  # surroundings of one anchor that share a shard; more are dealt to several
SLICE = 400_000


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """`best` of every `width` neighbours."""
    done = 1
    while 2 * done <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[: len(values) - (width - done)], values[width - done:]) if done < width else values


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of all anchors: text number, place, hash, and hashes of the anchor with half of what may stand before
    it in a string, with half of what may stand behind it, and with all surroundings.

    Every `length` bytes of a text hold the anchor that has the least hash among its GRAM-byte
    strings; equal strings have the same anchor at the same place.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    width = length - GRAM + 1
    if len(joined) < length:
        return (none, none, *[none.view(np.uint64)] * 4)
    gram = mix(np.arange(256, dtype=np.uint64))[joined]
    factor, span = np.uint64(0xD6E8FEB86659FD93), 1
    while span < GRAM:
        gram = gram[:-span] * factor + gram[span:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        span *= 2
    gram = mix(gram)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)[text]
    places = np.arange(len(joined))
    fits = (ends - places >= GRAM)[: len(gram)]
    key = np.where(fits, (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0xFFFFFFFF))
    # the least key of each whole string; strings that cross a text's end count for nothing
    least = np.where((ends - places >= length)[: len(key) - width + 1], _slide(key, width, np.minimum), 0)
    edge = np.zeros(width - 1, np.uint32)
    chosen = _slide(np.concatenate([edge, least, edge]).astype(np.uint32), width, np.maximum)
    at = np.flatnonzero(fits & (key == chosen))
    base = ends[at] - sizes[text[at]]
    start, stop = np.maximum(base, at - width + 1), np.minimum(ends[at], at + length)
    hashes, half = RangeHashes(joined), (width - 1) // 2

    def of(a, b):
        return mix(hashes.of(a, b) + (b - at).astype(np.uint64) * np.uint64(1_000_003) + (at - a).astype(np.uint64))

    before, behind = np.maximum(start, at - half), np.minimum(stop, at + GRAM + half)
    return text[at], at - base, gram[at], of(before, at + GRAM), of(at, behind), of(start, stop)


_FIELDS = (("doc_id", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("before", "<u4"), ("behind", "<u4"), ("s", "<u8"), ("gram", "<u8"))


def _dealt(buckets: int, length: int):
    def work(batches):
        held: list[tuple] = []
        waiting = 0

        def deal():
            columns = [np.concatenate(c) for c in zip(*held)]
            bucket = (columns[3] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = np.append(edge[1:], len(order))
            doc_id, tag, place, gram, before, behind, s = (c[order] for c in columns)
            # halves that agree by chance only cost a look, so 32 bits do; equal surroundings are told by all bits and the anchor's
            parts = (doc_id, tag, place, before >> np.uint64(32), behind >> np.uint64(32), s, gram)
            parts = [p.astype(kind) for p, (_, kind) in zip(parts, _FIELDS)]
            rows = [b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(edge.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][edge].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "anchors"])

        for part, texts in text_slices(batches, size=SLICE):
            text, *found = anchors([t.encode() for t in texts], length)
            held.append((np.asarray(part.column("doc_id"))[text], np.asarray(part.column("tag"))[text], *found))
            waiting += len(text)
            if waiting >= BLOCK_ANCHORS:
                yield deal()
                held, waiting = [], 0
        if waiting:
            yield deal()

    return work


def _read(data: bytes) -> list[np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in _FIELDS)
    count, at, out = len(data) // width, 0, []
    for _, kind in _FIELDS:
        out.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return out


def _alike(key: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Which rows share their key with a row of another document."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    ids = doc_id[order]
    out = np.empty(len(key), bool)
    out[order] = (np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at))[of]
    return out


def _compare(table: pa.Table, part_pieces: int = PART_PIECES) -> pa.Table:
    """Anchors of one bucket: places that repeat whole surroundings, and the first places of surroundings that
    agree with others in a half (`ask`), with the number of shards (`parts`) that their anchor needs."""
    columns = [np.concatenate(c) for c in zip(*(_read(x.as_buffer().to_pybytes()) for x in table.column("anchors").combine_chunks()))]
    order = np.lexsort((columns[0], columns[6], columns[5]))
    doc_id, tag, place, before, behind, s, gram = (c[order] for c in columns)
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (gram[1:] != gram[:-1])])
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    # rows of equal surroundings are in doc_id order
    repeat = doc_id > doc_id[at][of]
    alike = _alike(before[at], doc_id[at]) | _alike(behind[at], doc_id[at])
    ask = ~repeat & alike[of]
    told = np.flatnonzero(repeat | ask)
    _, anchor = np.unique(gram, return_inverse=True)
    parts = -(-np.bincount(anchor, ask).astype(np.int32) // part_pieces)[anchor]
    return pa.table({
        "doc_id": doc_id[told].astype(np.int64), "tag": tag[told].astype(np.int64), "place": place[told].astype(np.int32), "ask": ask[told],
        "parts": parts[told].astype(np.int32),
    })


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` (doc_id, tag, text) joined with `keys`, which has one row for each (doc_id, tag).

    While the keys' ids are few enough to be broadcast, texts without one are filtered out before the shuffle.
    """
    few = _few(keys)
    wanted = docs if few is None else docs.join(few, "doc_id", "left_semi")
    return wanted.join(keys, ["doc_id", "tag"])


def _few(keys: DataFrame) -> DataFrame | None:
    """The ids of `keys` for a broadcast, None if they are too many; a filter that shuffles texts would save nothing."""
    count = keys.count()
    return broadcast_within(keys.select("doc_id").distinct(), count) if count <= BROADCAST_ROWS else None


def _pieces(shards: int, length: int):
    around = length - GRAM

    def work(batches):
        for part, texts in text_slices(batches):
            out: list[tuple] = []
            for text, doc_id, tag, asked in zip(texts, part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), part.column("asked").to_pylist()):
                data = text.encode()
                for place, parts in ((a["place"], a["parts"]) for a in asked):
                    start = max(0, place - around)
                    shard = xxhash.xxh3_64_intdigest(data[place: place + GRAM])
                    if parts > 1:
                        # a negative shard holds one part of one anchor
                        part_of = xxhash.xxh3_64_intdigest(b"%d %d %d" % (doc_id, tag, place)) % parts
                        shard = ~(xxhash.xxh3_64_intdigest(b"%d %d" % (shard, part_of)) >> 1)
                    else:
                        shard %= shards
                    out.append((shard, doc_id, tag, start, data[start: place + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["shard", "doc_id", "tag", "start", "piece"]
            )

    return work


_SORTED = "doc_id long, tag long, start int, end int, string binary, least long, members array<struct<doc_id:long,tag:long,start:int>>"


def _sort_shard(length: int):
    """Of a whole shard: what repeats smaller documents. Of a part of an anchor: every different string, its smallest document and its members."""

    def work(table: pa.Table) -> pa.Table:
        doc_id, tag, start = (table.column(c).to_numpy() for c in ("doc_id", "tag", "start"))
        pieces = table.column("piece").to_pylist()
        if table.column("shard")[0].as_py() >= 0:
            number, first, last = repeated_windows(pieces, doc_id, length)
            strings, least, bounds, at = [None] * len(number), [None] * len(number), None, number
            ranges = [doc_id[number], tag[number], (start[number] + first).astype(np.int32), (start[number] + last + length).astype(np.int32)]
        else:
            strings, least, at, place, bounds = window_groups(pieces, doc_id, length)
            ranges = [[None] * len(strings)] * 4
        member = pa.struct([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32())])
        if bounds is None:
            members = pa.nulls(len(at), pa.list_(member))
        else:
            fields = [pa.array(doc_id[at], pa.int64()), pa.array(tag[at], pa.int64()), pa.array((start[at] + place).astype(np.int32))]
            members = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(member)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        columns = [pa.array(c, kind) for c, kind in zip((*ranges, strings, least), kinds)]
        return pa.Table.from_arrays([*columns, members], names=["doc_id", "tag", "start", "end", "string", "least", "members"])

    return work


def find_repeats(docs: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES) -> DataFrame:
    """What repeats strings of smaller documents in `docs` (doc_id, tag, text), as rows of two kinds.

    doc_id, tag and place: everything around an anchor there, that is the bytes from place - length + GRAM to
    place + length as far as the text goes. Or doc_id, tag, start and end: these bytes. Ranges may overlap.
    An anchor with more than `part_pieces` different surroundings to be sorted has several shards.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings need at least {2 * GRAM} bytes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = docs.select("doc_id", "tag", "text").mapInArrow(_dealt(buckets, length), "bucket int, anchors binary")
    found = materialize(
        dealt.groupBy("bucket").applyInArrow(
            lambda anchors_: _compare(anchors_, part_pieces), "doc_id long, tag long, place int, ask boolean, parts int"
        ), "anchors"
    )
    equal = found.filter("not ask").select("doc_id", "tag", "place")
    asked = materialize(found.filter("ask").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "parts")).alias("asked")), "asked")
    pieces = _texts(docs, asked).select("doc_id", "tag", "text", "asked").mapInArrow(
        _pieces(buckets, length), "shard long, doc_id long, tag long, start int, piece binary"
    )
    told = materialize(pieces.groupBy("shard").applyInArrow(_sort_shard(length), _SORTED), "sorted")
    whole = told.filter("string is null").select("doc_id", "tag", "start", "end")
    parts = told.filter("string is not null")
    # the parts' rows of a string meet once, without a join of them with themselves
    first = F.min("least").over(Window.partitionBy("string"))
    later = F.filter("members", lambda m: m["doc_id"] > F.col("first"))
    split = parts.select("members", first.alias("first")).select(F.inline(later)).withColumn("end", (F.col("start") + length).cast("int"))
    return equal.unionByName(whole.unionByName(split), allowMissingColumns=True)


def _removal(length: int):
    def work(batches):
        for part, texts in text_slices(batches):
            yield _remove(part, texts, length)

    return work


def _remove(part: pa.RecordBatch, texts: list[str], length: int) -> pa.RecordBatch:
    counts = np.zeros((3, len(texts)), np.int64)
    kept = []
    places, ranges = part.column("places").to_pylist(), part.column("ranges").to_pylist()
    for i, text in enumerate(texts):
        data = text.encode()
        counts[0, i] = len(data)
        if places[i] or ranges[i]:
            anchor = np.array(places[i] or [], np.int64)
            # ranges come as start and end in turn
            pairs = np.concatenate([
                np.stack([anchor - length + GRAM, anchor + length], 1), np.array(ranges[i] or [], np.int64).reshape(-1, 2)
            ])
            pairs = np.clip(pairs[np.argsort(pairs[:, 0], kind="stable")], 0, len(data))
            reach = np.maximum.accumulate(pairs[:, 1])
            new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
            first = np.flatnonzero(new)
            starts, ends = pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]
            counts[1, i], counts[2, i] = (ends - starts).sum(), len(first)
            data = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]))
        kept.append(data)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(kept, pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every row.

    A byte goes if it lies in `length` bytes that also start in a document with a smaller doc_id,
    judged on the texts as they came. Null texts count as empty. Rows without a doc_id have no
    place in the order: they stay whole and are no source. Rows with the same doc_id do not repeat each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # tells texts with the same doc_id apart, by all bits: millions of rows may have one doc_id
    rows = rows.withColumn("tag", F.xxhash64("text"))
    placed = rows.filter("doc_id is not null")
    found = find_repeats(placed, length, part_pieces)
    spans = materialize(
        found.groupBy("doc_id", "tag").agg(
            F.collect_list("place").alias("places"), F.flatten(F.collect_list(F.when(F.col("end").isNotNull(), F.array("start", "end")))).alias("ranges")
        ), "spans"
    )
    ids = _few(spans)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    hit = (rows if ids is None else rows.join(ids, "doc_id", "left_semi")).join(spans, ["doc_id", "tag"], "left")
    columns = ("doc_id", "text", "places", "ranges")
    out = hit.select(*columns).mapInArrow(_removal(length), schema)
    if ids is None:
        return out
    clean = rows.join(ids, "doc_id", "left_anti").withColumns({c: F.lit(None).cast("array<int>") for c in ("places", "ranges")})
    return out.unionByName(clean.select(*columns).mapInArrow(_removal(length), schema))


# Bytes as pairs of hexadecimal digits: 50 bytes are 100 of them.
REPEATS_SQL = """
with doc as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), place as (
  select r, doc_id, unnest(range(0, greatest(0, len(h) // 2 - 49))) as p, h from doc where doc_id is not null
), part as materialized (select r, doc_id, p, substr(h, 2 * p + 1, 100) as s from place),
origin as (select s, min(doc_id) as least from part group by s),
again as (select r, p from part join origin using (s) where least < doc_id),
marked as (select r, p, case when p <= lag(p) over (partition by r order by p) + 50 then 0 else 1 end as new from again),
numbered as (select r, p, sum(new) over (partition by r order by p) as g from marked),
span as (select r, min(p) as a, max(p) + 50 as b from numbered group by r, g),
gap as (
  select r, a as nth, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from span
  union all select r, 9223372036854775807, max(b), null from span group by r
), kept as (
  select r, string_agg(case when b is null then substr(h, 2 * a + 1) else substr(h, 2 * a + 1, 2 * (b - a)) end, '' order by nth) as k
  from gap join doc using (r) group by r
), total as (select r, sum(b - a) as n_removed, count(*) as n_spans from span group by r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(k, h))) as kept_sha256
from doc left join total using (r) left join kept using (r)
"""
