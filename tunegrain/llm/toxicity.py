"""Toxicity by maximum-scoring segments.

Words and word beginnings get log-odds of toxic against other texts, with a Dirichlet prior
from both together, reduced to their lower confidence bound and by a drift, so that ordinary
text scores below zero. A linear scan finds all maximal segments of a text. Their scores are
judged by extreme-value statistics of ordinary text (expected number of segments at least as
good), and the best one's log expectation is mapped to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.llm.encode import text_slices
from tunegrain.llm.shingles import Shingler
from tunegrain.runtime import materialize

SAMPLE_ROWS = 40_000  # labelled rows that are learned from, at most
FEATURES = 200_000  # weights that are kept, at most; those furthest from zero
LEAST_TEXTS = 6
PRIOR = 0.1
CONFIDENCE = 2.58
DRIFT = 0.5
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (6, 5, 4)
KNOWN_WORDS = 400_000  # a worker's memory of word scores is emptied beyond this
SIGNIFICANT = 0.05


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    decay: float  # lambda of the extreme-value law
    scale: float  # K of the extreme-value law
    slope: float
    intercept: float

    def surprise(self, score, words):
        """Minus the log of the expected number of such segments in ordinary text of that length."""
        return self.decay * score - np.log(self.scale * np.maximum(words, 1))

    def probability(self, surprise):
        return 1 / (1 + np.exp(-np.clip(self.slope * surprise + self.intercept, -30, 30)))


class WordScores(dict):
    """Word, in any case -> its score, the highest of its known features less the drift."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self._weights = weights

    def __missing__(self, word: str) -> float:
        known = [self._weights[f] for f in features(word.lower()) if f in self._weights]
        value = self[word] = (max(known) if known else 0.0) - DRIFT
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in order, in linear time.

    Positive scores enter one at a time with the running total before and after; a new
    segment swallows the last one that starts lower and ends below it.
    """
    totals = np.cumsum(scores)
    stack: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    links: list[int] = []  # for each, the nearest earlier one with a smaller total before it
    for i in np.flatnonzero(scores > 0).tolist():
        first, before, after = i, totals[i] - scores[i], totals[i]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = links[j]
            if j < 0 or stack[j][3] >= after:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
        stack.append((first, i + 1, before, after))
        links.append(j)
    return [(a, b, float(after - before)) for a, b, before, after in stack]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _keys(batches):
    shingler = Shingler()
    for part, texts in text_slices(batches):
        sets = shingler.sets(texts)
        turned = np.uint64(0x5555555555555555)
        pairs = [(s[0], (s ^ turned).min()) if len(s) else (0, 0) for s in sets]
        least = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(least[:, 0]), pa.array(least[:, 1])], names=["doc_id", "text", "_y", "_a", "_b"]
        )


def _sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled texts outside the held-out fold, chosen by a hash of doc_id.

    Of texts that share their least shingle, by either of two orders, one is kept: the
    words of a text that was copied many times would look like signs of its label.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("_y")).dropna()
        .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # `rows` bounds this side, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().join(F.broadcast(chosen), "doc_id")
    single = texts.mapInArrow(_keys, "doc_id long, text string, _y int, _a long, _b long")
    for key in ("_a", "_b"):
        single = single.groupBy(key).agg(F.min_by(F.struct(*single.columns), F.struct("doc_id", "text")).alias("r")).select("r.*")
    return single.select("text", "_y")


def _count(batches):
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        names = list(seen[0] | seen[1])
        row = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([seen[y][f] for f in names], pa.int64()) for y in (1, 0))],
            names=["feature", "toxic", "other"],
        )
        for c in seen.values():
            c.clear()
        return row

    for part, texts in text_slices(batches):
        for text, y in zip(texts, part.column("_y").to_pylist()):
            found = set()
            for word in set(WORD.findall(text)):
                found.update(features(word.lower()))
            seen[int(y == 1)].update(found)
        if len(seen[0]) + len(seen[1]) > 300_000:
            yield flush()
    yield flush()


def _weights(sample: DataFrame) -> dict[str, float]:
    counts = (
        sample.mapInArrow(_count, "feature string, toxic long, other long").groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    )
    counts = materialize(counts.filter(F.col("t") + F.col("o") >= LEAST_TEXTS), "counts")
    # words and beginnings of one length are separate alphabets
    kind = F.when(F.col("feature").endswith("*"), F.length("feature")).otherwise(0)
    totals = {r["k"]: (r["t"] or 0, r["o"] or 0) for r in counts.groupBy(kind.alias("k")).agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect()}
    if not totals:
        return {}
    prior = PRIOR * (F.col("t") + F.col("o"))
    rest = F.lit(0.0)
    for k, (t, o) in totals.items():
        rest = F.when(kind == k, math.log((o + PRIOR * (t + o)) / (t + PRIOR * (t + o)))).otherwise(rest)
    odds = F.log((F.col("t") + prior) / (F.col("o") + prior)) + rest
    doubt = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("o") + prior))
    bound = F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - CONFIDENCE * doubt)
    kept = counts.select("feature", bound.alias("w")).filter("w <> 0").orderBy(F.desc(F.abs("w")), "feature").limit(FEATURES)
    return {r["feature"]: r["w"] for r in kept.collect()}


def _law(histogram: Counter) -> float:
    """The positive root of the mean of exp(x * score) = 1 over ordinary words."""
    values = np.array([*histogram, 3.0, 1.0])
    share = np.array([*histogram.values(), 1, 1], float)  # a pseudo-count keeps the root finite
    share /= share.sum()
    low, high = 1e-6, 200.0 / max(values.max(), 0.1)
    if (share * values).sum() >= 0:
        return 0.1
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * values)).sum() < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps that never lower the likelihood; a weak ridge lets separable samples converge."""
    center, width = np.average(x, weights=weight), max(1e-9, np.sqrt(np.cov(x, aweights=weight)) if len(x) > 1 else 1.0)
    design = np.stack([(x - center) / width, np.ones_like(x)], 1)

    def loss(beta):
        z = design @ beta
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * beta @ beta

    beta, step = np.zeros(2), np.ones(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 0.1 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0] / width), float(beta[1] - beta[0] * center / width)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most `sample_rows` labelled rows outside the held-out fold.

    Rows with a null text or label teach nothing; of several labels for a document the highest
    counts. Without any labelled row every text gets a probability of one half or less.
    """
    sample = materialize(_sample(docs, labels, label, sample_rows), "labelled")
    weights = _weights(sample)

    def measure(batches):
        scores, found = WordScores(weights), Counter()
        for part, texts in text_slices(batches):
            for text, y in zip(texts, part.column("_y").to_pylist()):
                words = np.fromiter(map(scores.__getitem__, WORD.findall(text)), float)
                best = max((s[2] for s in maximal_segments(words)), default=0.0)
                # two digits each: the number of different rows stays bounded
                found["text", int(y == 1), float(f"{best:.2g}"), float(f"{len(words):.2g}")] += 1
                if y != 1:
                    values, counts = np.unique(np.round(words, 1), return_counts=True)
                    for v, c in zip(values.tolist(), counts.tolist()):
                        found["word", 0, v, 0.0] += c
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.float64()),
             pa.array([k[3] for k in keys], pa.float64()), pa.array(list(found.values()), pa.int64())],
            names=["kind", "y", "a", "b", "n"],
        )

    rows = (
        sample.mapInArrow(measure, "kind string, y long, a double, b double, n long")
        .groupBy("kind", "y", "a", "b").agg(F.sum("n").alias("n")).collect()
    )
    decay = _law(Counter({r["a"]: r["n"] for r in rows if r["kind"] == "word"}))
    texts = np.array([(r["y"], r["a"], r["b"], r["n"]) for r in rows if r["kind"] == "text"]).reshape(-1, 4)
    y, best, words, n = texts.T
    clean = y == 0
    expected = (n * np.maximum(words, 1) * np.exp(-decay * best))[clean].sum()
    scale = float(n[clean].sum() / expected) if expected > 0 else 1.0
    model = ToxicityModel(weights, decay, scale, 1.0, 0.0)
    slope, intercept = _logistic(model.surprise(best, words), y, n) if len(y) else (1.0, 0.0)
    return ToxicityModel(weights, decay, scale, slope, intercept)


class Scorer:
    """Scores texts in a task; word scores are remembered between slices."""

    def __init__(self, model: ToxicityModel):
        self._model, self._scores = model, WordScores(model.weights)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Probability and significant passages of each text."""
        best, count, passages = np.zeros(len(texts)), np.zeros(len(texts)), []
        for i, text in enumerate(texts):
            found = []
            # words are found before they are lower-cased, which may split one ("İ" gets a mark of its own)
            words = np.fromiter(map(self._scores.__getitem__, WORD.findall(text or "")), float)
            count[i] = len(words)
            if len(words) and words.max() > 0:
                segments = maximal_segments(words)
                best[i] = max(s[2] for s in segments)
                places = [m.span() for m in WORD.finditer(text)]
                for first, end, score in segments:
                    expected = math.exp(-self._model.surprise(score, len(words)))
                    if expected < SIGNIFICANT:
                        found.append({"start": places[first][0], "end": places[end - 1][1], "expected": expected})
            passages.append(found)
        if len(self._scores) > KNOWN_WORDS:
            self._scores.clear()
        return self._model.probability(self._model.surprise(best, count)), passages


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted and passages (start, end in code points, expected number) of every row.

    Passages are the segments that ordinary text of that length shows less than SIGNIFICANT
    times. Null and empty texts count as texts without words. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))

    def work(batches):
        scorer = Scorer(model)
        for part, texts in text_slices(batches):
            probability, passages = scorer.score(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(probability), pa.array((probability >= 0.5).astype(np.int32)), pa.array(passages, passage)],
                names=["doc_id", "score", "predicted", "passages"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, score double, predicted int, passages array<struct<start: bigint, end: bigint, expected: double>>"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs`, with all columns, whose text is not predicted toxic."""
    def work(batches):
        scorer = Scorer(model)
        for part, texts in text_slices(batches):
            yield part.filter(pa.array(scorer.score(texts)[0] < 0.5))

    return docs.mapInArrow(work, docs.schema)
