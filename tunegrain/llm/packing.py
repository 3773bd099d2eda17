"""Best-fit packing of documents into sequences, certified by dual feasible functions.

Every partition of the pieces is packed by best-fit decreasing and compared with a lower bound
on its sequences. Sequences with room, and all sequences with any room where the bound was
missed, give their pieces back; those are dealt into fewer partitions and packed again, until
one partition holds what is left. After a round without progress sequences with room stay where the bound is met.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.llm.encode import TextEncoder, default_tokenizer, text_slices
from tunegrain.runtime import materialize

CAPACITY = 4096
GROUP_ROWS = 65_536
MAX_ROUNDS = 8


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Cut the ids of each document (with the end id) into pieces of at most `capacity`.

    Null and empty texts have the end id only. Repeated rows are pieces of their own, a null
    doc_id stays null, other columns are not read.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encoder = TextEncoder(path)
        for part, texts in text_slices(batches):
            ids, lengths = encoder.encode(texts, end_id)
            pieces = -(-lengths // capacity)
            of = np.repeat(np.arange(len(texts)), pieces)
            number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            size = np.minimum(capacity, lengths[of] - start)
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            at = (np.repeat(np.cumsum(lengths) - lengths, pieces) + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + size * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start),
                 pa.array(size), pa.array(np.array(crc, np.int64))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; a piece goes where the least room stays, longest pieces first."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0  # bit r of open_rooms: a bin with r free places is open
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, at = capacity, used
            used += 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - size:
            rooms[left].append(at)
            open_rooms |= 1 << left
    return bins, offsets


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; histogram[s] counts the pieces of size s.

    The largest value over two families of dual feasible functions: those that round pieces
    above capacity - e up to a whole bin and drop those below e, and those that round
    multiples of 1/(k + 1) down.
    """
    sizes = np.arange(capacity + 1)
    count = np.concatenate([[0], np.cumsum(histogram)])
    volume = np.concatenate([[0], np.cumsum(histogram * sizes)])
    e = np.arange(0, capacity // 2 + 1)
    whole = count[-1] - count[capacity - e + 1]
    middle = volume[capacity - e + 1] - volume[e]
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 41):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # k * capacity times the function's value, as integers
        value = np.where(exact, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((histogram * value).sum()) // (k * capacity)))
    return best


def _pack_group(capacity: int, turn: int, last: bool, settle: bool = False):
    loose = capacity // 32

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        room = capacity - np.bincount(bins, lengths, used).astype(np.int64)
        gap = used - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        free = np.zeros(used, bool) if last or settle and not gap else room > (0 if gap else loose)
        group = int(part["pack"].iloc[0])
        return pd.DataFrame({
            "row": part["row"], "length": part["length"], "sequence_id": (turn << 56) + (group << 28) + bins,
            "offset": offsets, "free": free[bins],
        })

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pieces` with sequence_id, offset and least_sequences added; pieces need a length of 1 to `capacity`.

    least_sequences is the certificate, the same in every row: the lower bound over the lengths of all pieces, so a
    packing of as many sequences is the best there is. Up to MAX_ROUNDS rounds exchange pieces; the last one
    places all that is left, at the cost of sequences with room. Each round is written, so it is planned from counts and survives lost executors. A task
    holds about `group_rows` lengths. No piece is dropped; an empty table gives an empty table.
    """
    stored = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    open_, placed, turn, settle = stored.select("row", "length"), None, 0, False
    histogram = np.zeros(capacity + 1, np.int64)
    for size, count in open_.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[size] = count
    left = int(histogram.sum())
    least = lower_bound(histogram, capacity)
    while True:
        groups = max(1, -(-left // group_rows))
        last = groups == 1 or turn == MAX_ROUNDS
        dealt = open_.withColumn("pack", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        done = materialize(
            dealt.groupBy("pack").applyInPandas(
                _pack_group(capacity, turn, last, settle), "row long, length long, sequence_id long, offset long, free boolean"
            ), "packed",
        )
        kept = done.filter(~F.col("free")).select("row", "sequence_id", "offset")
        placed = kept if placed is None else placed.unionByName(kept)
        if last:
            break
        open_ = done.filter("free").select("row", "length")
        before, left, turn = left, open_.count(), turn + 1
        # no sequence was filled: partitions that met their bound are done, others are dealt anew
        settle = left == before
    return stored.join(placed, "row").drop("row").withColumn("least_sequences", F.lit(least).cast("long"))


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, tokenizer: str | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Documents cut into pieces and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset, least_sequences."""
    return pack_pieces(token_pieces(docs, capacity, end_id, tokenizer), capacity, group_rows)
