"""Token ids as Re-Pair grammars: one compressed block per shard, read back at random.

A block is one value of a binary column; blocks are written as a Parquet table in a folder that
all executors reach, so Spark's commit protocol covers lost and repeated tasks.
Block: magic, counts (documents, rules, symbols) as little-endian uint64, then the arrays
doc_id int64, ids per document uint32, left and right side of each rule uint32, expansion
length of each rule uint32, symbols uint32. Ids below 65,536 are terminals; symbol
65,536 + r is rule r.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunegrain.llm.encode import default_tokenizer, text_slices, worker_encoder
from tunegrain.runtime import broadcast_within, new_folder

MAGIC = b"TGRP0001"
FIRST_RULE = 1 << 16
BLOCK_IDS = 1 << 20
# A rule takes three numbers in the block and each use saves one, so it pays from this many uses on.
LEAST_USES = 4


def _grouped(pairs: np.ndarray, slots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each of the `pairs` and the pair of each number; equal pairs have equal numbers.

    The number is the pair's hash slot. Where different pairs share a slot, new numbers are given.
    """
    table = np.zeros(1 << bits, np.uint64)
    table[slots] = pairs
    shared = slots[table[slots] != pairs]
    if not len(shared):
        return slots, table
    several = np.zeros(1 << bits, bool)
    several[shared] = True
    inside = np.flatnonzero(several[slots])
    others, number = np.unique(pairs[inside], return_inverse=True)
    slots = slots.copy()
    slots[inside] = (1 << bits) + number
    return slots, np.concatenate([table, others])


def _every_second(same: np.ndarray) -> np.ndarray:
    """True for the first, third, ... of each run; same[i]: i + 1 goes on with the run of i."""
    place = np.arange(len(same) + 1)
    first = np.append(True, ~same)
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0


def re_pair(ids: np.ndarray, rounds: int | None = None, least: int = LEAST_USES):
    """Symbols and rules (left, right) that expand to `ids`.

    A round counts the pairs without overlaps and replaces those that occur `least` times; where occurrences of two pairs
    overlap, the one of the more frequent pair wins. Equally frequent pairs are ordered by a hash, so that many of
    them in a row are settled in few rounds. Rounds go on until no pair occurs so often, or to the number of `rounds`.
    The first pair in that order wins everywhere, so each round makes a rule.

    Replaced places stay where they are and are linked to the next living one; a round costs what can still change.
    """
    n = len(ids)
    index = np.int32 if n < 1 << 31 else np.int64
    symbols = ids.astype(np.uint32)
    after, before = np.arange(1, n + 1, dtype=index), np.arange(-1, n, dtype=index)
    alive, live = np.ones(n, bool), np.ones(n, bool)
    live[-1:] = False
    wins = np.full(n + 1, -1, index)  # order of the occurrence that starts here; the last one stands for both ends
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    rules = done = 0
    while rounds is None or done < rounds:
        # Pairs that start at live places may still occur often enough. Counts of known pairs only fall, so a pair that is
        # too rare stays out, and only pairs with a new symbol come in.
        places = np.flatnonzero(live)
        if len(places) < least:
            break
        a, b = symbols[places], symbols[after[places]]
        # a slot holds all occurrences of its pairs, so those of rare slots need no exact count
        bits = min(20, max(8, len(places).bit_length()))
        slots = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - bits)
        often = (np.bincount(slots, minlength=1 << bits) >= least)[slots]
        if not often.all():
            live[places[~often]] = False
            places, a, b, slots = places[often], a[often], b[often], slots[often]
        if not len(places):
            break
        of, found = _grouped((a.astype(np.uint64) << np.uint64(32)) | b, slots, bits)
        own = np.ones(len(places), bool)
        twin = np.flatnonzero(a == b)
        if len(twin):  # in a run of one symbol every second occurrence of its pair
            own[twin] = _every_second((after[places[twin[:-1]]] == places[twin[1:]]) & (a[twin[:-1]] == a[twin[1:]]))
        count = np.bincount(of[own], minlength=len(found))
        paying = np.flatnonzero(count >= least)
        if not len(paying):
            break
        found = found[paying]
        mixed = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        order = np.lexsort((mixed * np.uint64(0x94D049BB133111EB), count[paying]))
        ranks = np.full(len(count), -1, index)
        ranks[paying[order]] = np.arange(len(paying), dtype=index)
        rank = ranks[of]
        live[places[rank < 0]] = False
        own &= rank >= 0
        at, rank = places[own], rank[own]
        wins[at] = rank
        own = (wins[before[at]] < rank) & (wins[after[at]] < rank)
        wins[at] = -1
        at, rank = at[own], rank[own]
        good = np.bincount(rank, minlength=len(order)) >= least
        own = good[rank]
        at, rule = at[own], (np.cumsum(good) - 1)[rank[own]]
        found = found[order[good]]
        left.append((found >> np.uint64(32)).astype(np.uint32))
        right.append((found & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        gone = after[at]
        symbols[at] = (FIRST_RULE + rules + rule).astype(np.uint32)
        after[at] = after[gone]
        before[after[at]] = at
        alive[gone] = live[gone] = False
        live[at] = after[at] < n
        previous = before[at]
        live[previous[previous >= 0]] = True
        rules += len(found)
        done += 1
    return symbols[alive], np.concatenate(left), np.concatenate(right)


def expansion_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids below each rule; a rule's sides are earlier rules or terminals."""
    sizes = np.ones(FIRST_RULE + len(left), np.int64)
    while True:
        new = sizes[left] + sizes[right]
        if np.array_equal(new, sizes[FIRST_RULE:]):
            return new
        sizes[FIRST_RULE:] = new


def expand(
    symbols: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray | None = None, start: int = 0, stop: int | None = None
) -> np.ndarray:
    """The ids `start` to `stop` of those below `symbols`, by descent: only rules above wanted ids are looked at.

    `sizes` are the rules' expansion lengths. Every step splits all open symbols into their sides and writes ids out. Rules that
    stand among `symbols` are written out once, where that is less than half of what is wanted.
    """
    sizes = expansion_lengths(left, right) if sizes is None else sizes
    if start == 0 and stop is None and len(sizes):
        used = np.flatnonzero(np.bincount(symbols[symbols >= FIRST_RULE] - FIRST_RULE, minlength=len(sizes)))
        widths = np.ones(FIRST_RULE + len(sizes), np.int64)
        widths[FIRST_RULE:] = sizes
        widths, below = widths[symbols], int(sizes[used].sum())
        if 2 * below < int(widths.sum()):
            flat = np.concatenate([np.arange(FIRST_RULE, dtype=np.uint32), expand(FIRST_RULE + used, left, right, sizes, 0, below)])
            starts = np.arange(FIRST_RULE + len(sizes))
            starts[FIRST_RULE + used] = FIRST_RULE + np.cumsum(sizes[used]) - sizes[used]
            shift = np.repeat(starts[symbols] - (np.cumsum(widths) - widths), widths)
            shift += np.arange(len(shift))
            return flat[shift]

    def width(symbols):
        known = np.ones(len(symbols), np.int64)
        rule = symbols >= FIRST_RULE
        known[rule] = sizes[symbols[rule] - FIRST_RULE]
        return known

    symbols = symbols.astype(np.int64)
    widths = width(symbols)
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    out = np.empty(max(0, stop - start), np.uint32)
    places = ends - widths - start
    while len(symbols):
        wanted = (places < len(out)) & (places + widths > 0)
        if not wanted.all():
            symbols, places = symbols[wanted], places[wanted]
        terminal = symbols < FIRST_RULE
        out[places[terminal]] = symbols[terminal]
        rule, places = symbols[~terminal] - FIRST_RULE, places[~terminal]
        first, second = left[rule].astype(np.int64), right[rule].astype(np.int64)
        one = width(first)
        symbols, places = np.concatenate([first, second]), np.concatenate([places, places + one])
        widths = np.concatenate([one, sizes[rule] - one])
    return out


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, left, right = re_pair(ids)
    sizes = expansion_lengths(left, right)
    head = np.array([len(doc_ids), len(left), len(symbols)], "<u8")
    arrays = (head, doc_ids.astype("<i8"), lengths.astype("<u4"), left.astype("<u4"), right.astype("<u4"), sizes.astype("<u4"), symbols.astype("<u4"))
    return MAGIC + b"".join(a.tobytes() for a in arrays)


class Block:
    """A block read back; `ids(start, count)` decodes only the symbols that cover the range."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a grammar block")
        docs, rules, symbols = np.frombuffer(data, "<u8", 3, 8).tolist()
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
        self._left = np.frombuffer(data, "<u4", rules, at := at + 4 * docs)
        self._right = np.frombuffer(data, "<u4", rules, at := at + 4 * rules)
        self._sizes = np.frombuffer(data, "<u4", rules, at := at + 4 * rules).astype(np.int64)
        self._symbols = np.frombuffer(data, "<u4", symbols, at + 4 * rules)
        rule = self._symbols >= FIRST_RULE
        width = np.ones(symbols, np.int64)
        width[rule] = self._sizes[self._symbols[rule].astype(np.int64) - FIRST_RULE]
        self._ends = np.cumsum(width)

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        total = int(self._ends[-1]) if len(self._ends) else 0
        stop = total if count is None else min(total, start + count)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._ends, start, "right"), np.searchsorted(self._ends, stop - 1, "right") + 1
        skip = int(self._ends[a - 1]) if a else 0
        if stop - start == total:
            return expand(self._symbols, self._left, self._right, self._sizes)
        return expand(self._symbols[a:b], self._left, self._right, self._sizes, start - skip, stop - skip)

    def document(self, index: int) -> np.ndarray:
        return self.ids(int(self.lengths[:index].sum()), int(self.lengths[index]))


def write_ids(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, partitions: int | None = None) -> None:
    """Encode whole texts in ascending doc_id order and write grammar blocks to `path`.

    Null and empty texts hold the end id only. Rows with the same doc_id stay next to each other,
    ordered by text; rows without a doc_id are refused by an error, as they have no place in
    the order. Other columns are not read.
    """
    name = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        encoder, part = worker_encoder(name), TaskContext.get().partitionId()
        held: list[tuple] = []
        waiting = number = start = 0

        def flush():
            nonlocal held, waiting, number, start
            ids = np.concatenate([h[2] for h in held])
            data = write_block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((part, pa.int32()), (number, pa.int32()), (start, pa.int64()), (len(ids), pa.int64()), (data, pa.binary()))],
                names=["part", "block", "start", "n_ids", "data"],
            )
            held, waiting, number, start = [], 0, number + 1, start + len(ids)
            return row

        for rows, texts in text_slices(batches):
            if rows.column("doc_id").null_count:
                raise ValueError("write_ids needs a doc_id in every row")
            ids, lengths = encoder.encode(texts, end_id)
            if int(ids.max()) >= FIRST_RULE:
                raise ValueError("ids above 65,535 need another block format")
            held.append((np.asarray(rows.column("doc_id")), lengths, ids))
            waiting += len(ids)
            if waiting >= BLOCK_IDS:
                yield flush()
        if held:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(blocks, "part int, block int, start long, n_ids long, data binary")
        .write.parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the blocks: doc_id, start, n_tokens, ids_crc32.

    Only one row per written partition is ordered in one task; everything else stays with its block.
    """
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column("data")[row].as_buffer().to_pybytes())
                data = memoryview(block.ids().astype("<u4")).cast("B")
                lengths = block.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist())]
                first = batch.column("offset")[row].as_py() + batch.column("start")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids.astype(np.int64)), pa.array(first + ends - lengths), pa.array(lengths), pa.array(np.array(crc, np.int64))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row per partition that wrote blocks
    return blocks.join(broadcast_within(offsets, sums.count()), "part").select("offset", "start", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def encode_documents(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write `docs` as grammar blocks and read them back; see `write_ids` and `read_ids`."""
    path = path or new_folder(docs.sparkSession, "grammar")
    write_ids(docs, path, end_id, tokenizer)
    return read_ids(docs.sparkSession, path)
