"""Document fingerprints by locally consistent parsing.

A level joins neighbouring symbols to phrases and names each phrase by a hash of its symbols, so
names agree between documents without any exchange. Where a phrase ends depends on a few
neighbours only: runs of one symbol are one phrase; elsewhere deterministic coin tossing
(the lowest differing bit against the left neighbour, three times over) leaves labels below 8, and a
phrase starts at each local maximum. Equal passages therefore get equal names, up to their
edges, wherever they stand. The top name is the text's signature; a one-permutation
sketch of the names from the second level on gives the likeness of two texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.llm.encode import text_slices

BINS = 64
# Bytes of text that are parsed at once: small enough for a processor's cache.
SLICE = 300_000
FIRST_LEVEL = 2  # phrases of about a dozen characters; shorter ones are shared by all texts of a language
_STEP, _RUN, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, np.uint64(0xD6E8FEB86659FD93))]))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(labels: int) -> np.ndarray:
    own, left = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    differ = own ^ left
    bit = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    return np.where(differ == 0, own & 1, 2 * bit + (own >> np.minimum(bit, 7) & 1)).astype(np.uint8).ravel()


_TOSS = _toss(128)


def _phrase_starts(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where phrases start; `head` marks the first symbol of each text, neighbours differ."""
    differ = symbols[1:] ^ symbols[:-1]
    low = differ & (~differ + np.uint64(1))
    labels = np.empty(len(symbols), np.uint8)
    labels[1:] = 2 * np.bitwise_count(low - np.uint64(1)) + ((symbols[1:] & low) != 0)
    labels[head] = (symbols[head] & np.uint64(1)).astype(np.uint8)
    for _ in range(2):
        tossed = _TOSS[(labels[1:].astype(np.int32) << 7) | labels[:-1]]
        first = labels[head] & 1
        labels[1:] = tossed
        labels[head] = first
    above = np.zeros(len(symbols), bool)
    above[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    above[:-1] &= ~head[1:]  # a text's last symbol starts no phrase, so texts always get shorter
    return np.flatnonzero(above | head)


def parse(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parse texts that stand one after another.

    Returns the top name of each text (0 if empty), and names with the text each belongs to.
    """
    top = np.zeros(len(sizes), np.uint64)
    texts = np.flatnonzero(sizes)
    symbols = mix(codes.astype(np.uint64) + _STEP)
    head = np.zeros(len(symbols), bool)
    head[(np.cumsum(sizes) - sizes)[texts]] = True
    names, owners = [], []
    level = 0
    while len(symbols):
        at = np.flatnonzero(head)
        single = np.diff(np.append(at, len(symbols))) == 1
        if single.any():
            top[texts[single]] = symbols[at[single]]
            keep = np.ones(len(symbols), bool)
            keep[at[single]] = False
            symbols, head, texts = symbols[keep], head[keep], texts[~single]
            if not len(symbols):
                break
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | head[1:]
        if not new.all():
            starts = np.flatnonzero(new)
            runs = np.diff(np.append(starts, len(symbols)))
            long = runs > 1
            symbols, head = symbols[starts], head[starts]
            symbols[long] = mix(symbols[long] * _RUN + runs[long].astype(np.uint64))
        starts = _phrase_starts(symbols, head)
        lengths = np.diff(np.append(starts, len(symbols)))
        place = np.arange(len(symbols)) - np.repeat(starts, lengths)
        symbols = mix(np.add.reduceat(symbols * _POWERS[place], starts) + lengths.astype(np.uint64) * _LENGTH)
        head = head[starts]
        level += 1
        if level >= FIRST_LEVEL:
            names.append(symbols)
            owners.append(texts[np.cumsum(head) - 1])
    texts = np.flatnonzero(sizes)
    return top, np.concatenate([*names, top[texts]]), np.concatenate([*owners, texts])


def sketch(top: np.ndarray, names: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """A row of BINS values per text: the least name of each bin, cut to 16 bits; 0 where a bin is empty."""
    hashed = mix(names + _STEP)
    slot = owners.astype(np.uint64) * np.uint64(BINS) + hashed % np.uint64(BINS)
    ordered = np.sort((slot << np.uint64(36)) | (hashed >> np.uint64(28)))
    slot = ordered >> np.uint64(36)
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
    out = np.zeros(len(top) * BINS, np.uint16)
    out[slot[first].astype(np.int64)] = mix(ordered[first] & np.uint64((1 << 36) - 1)) % np.uint64(65535) + np.uint64(1)
    return out.reshape(-1, BINS)


def likeness(top_a, bins_a, top_b, bins_b) -> np.ndarray:
    """Estimated share of common names: equal bins among those that either text fills; 1 for equal tops."""
    filled = ((bins_a != 0) | (bins_b != 0)).sum(-1)
    equal = ((bins_a == bins_b) & (bins_a != 0)).sum(-1)
    return np.where(top_a == top_b, 1.0, equal / np.maximum(filled, 1))


def as_text(top: np.ndarray, bins: np.ndarray) -> list[str]:
    rows = bins.astype(">u2")
    return [f"{t:016x}{r.tobytes().hex()}" for t, r in zip(top.tolist(), rows)]


def fingerprint_likeness(a: str, b: str) -> float:
    """Likeness of two written fingerprints, between 0 and 1."""
    def read(x):
        return int(x[:16], 16), np.frombuffer(bytes.fromhex(x[16:]), ">u2")

    (top_a, bins_a), (top_b, bins_b) = read(a), read(b)
    return float(likeness(top_a, bins_a, top_b, bins_b))


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tops and sketches of texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    top, names, owners = parse(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), sizes)
    return top, sketch(top, names, owners)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; a null text counts as empty, other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for rows, texts in text_slices(batches, size=SLICE):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(as_text(*fingerprints([t or "" for t in texts])))], names=["doc_id", "fingerprint"]
            )

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fingerprint string")


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows in descending doc_id order within `bucket`, each bucket closed by the first row of the next one (donor = 1).

    Buckets are ranges of doc_id, so a row's successor is the next row of its task. Only each
    bucket's first doc_id comes to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a null doc_id comes last
    rows = rows.withColumn("_place", F.coalesce("doc_id", F.lit(-(2**63))))
    keys = rows.select("_place", F.col("_place").cast("double").alias("_key"))
    cuts = keys.approxQuantile("_key", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket")
    firsts = {int(r[0]): r[1] for r in cut.transform(keys).groupBy("_bucket").agg(F.max("_place")).collect()}
    if not firsts:
        return rows.withColumns({"bucket": F.lit(0), "donor": F.lit(0)})
    filled = sorted(firsts)
    before = {b: filled[i + 1] if i + 1 < len(filled) else filled[0] for i, b in enumerate(filled)}
    slots = range(filled[-1] + 1)
    first = F.array(*[F.lit(firsts.get(b, 0)).cast("long") for b in slots])
    target = F.array(*[F.lit(before.get(b, 0)) for b in slots])
    own = F.col("_bucket").cast("int")
    marked = cut.transform(rows.withColumn("_key", F.col("_place").cast("double"))).withColumn("own", own)
    places = F.when(
        F.col("_place") == first[F.col("own")],
        F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("donor")), F.struct(target[F.col("own")].alias("bucket"), F.lit(1).alias("donor"))),
    ).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("donor"))))
    return marked.select("doc_id", "text", "_place", F.inline(places))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form (its second half replaced by the start of the next document).

    The next document is the one with the next smaller doc_id (rows with equal doc_id: by text), after
    the last one the first. Null texts count as empty, a null doc_id is the smallest. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Texts
    are shuffled once.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        _in_order(docs, 4 * partitions).repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "donor", F.desc("_place"), "text").select("bucket", "donor", "doc_id", "text")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches):
        held = None  # the last row waits for its successor
        for rows, texts in text_slices(batches, size=SLICE):
            top, bins = fingerprints(texts)
            bucket, donor, ids = (rows.column(i).to_pylist() for i in range(3))
            if held:
                bucket, donor, ids, texts = [held[0], *bucket], [held[1], *donor], [held[2], *ids], [held[3], *texts]
                top, bins = np.concatenate([[held[4]], top]), np.concatenate([[held[5]], bins])
            held = (bucket[-1], donor[-1], ids[-1], texts[-1], top[-1], bins[-1])
            at = [i for i in range(len(ids) - 1) if not donor[i] and bucket[i] == bucket[i + 1]]
            if not at:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
            edited_top, edited_bins = fingerprints(edited)
            k = np.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(as_text(top[k], bins[k])), pa.array(as_text(edited_top, edited_bins)),
                    pa.array(likeness(top[k], bins[k], edited_top, edited_bins)),
                    pa.array(likeness(top[k], bins[k], top[k + 1], bins[k + 1])),
                ], names=names,
            )

    return ordered.mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
