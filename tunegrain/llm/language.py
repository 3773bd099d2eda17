"""Language of words and texts by a linear-chain conditional random field.

Every word has features: its letter n-grams, its beginnings and endings (n-grams that hold the
mark before or behind the word) and the word itself. Their weights and the weights of a change from one
language to another are learned together by the likelihood of whole label sequences, a
quarter of them spliced from two languages. Forward-backward gives each word's posterior, a
text's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.llm.encode import text_slices
from tunegrain.runtime import broadcast_within, materialize

SAMPLE_TEXTS = 1_000  # texts per language that are learned from, about
TOTAL_TEXTS = 64_000  # and of all languages together
LANGUAGES = 1_000  # languages that are learned, those of most different texts
WEIGHTS = 1 << 24  # weights in a model; with more languages features share slots
WINDOW, WINDOWS = 32, 4  # words in a training sequence, at most, and sequences per text
SLOTS = 1 << 17  # hashed features
NGRAMS = (1, 2, 3, 4)
BLOCK = 64
STATES = 1 << 23  # entries of transfer matrices in one call, about
KNOWN_WORDS = 400_000
DRAWS = 1_000_003
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words in a row, and how many each word has."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # letters from here to the word's end
    factor = np.uint64(0x9E3779B97F4A7C15)
    slots, owners = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        rolling[: len(codes) - n + 1] = (rolling[: len(codes) - n + 1] + codes[n - 1:]) * factor
        if n in NGRAMS:
            at = np.flatnonzero(rest >= n)
            slots.append((rolling[at] ^ (rolling[at] >> np.uint64(29))) * factor >> np.uint64(64 - 17))
            owners.append(word[at])
    # the whole word, as a sum over its letters by place
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spread = (codes + np.uint64(7)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * factor)
    spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.add.reduceat(spread, np.cumsum(sizes) - sizes) if len(words) else np.zeros(0, np.uint64)
    slots.append((whole ^ (whole >> np.uint64(30))) * factor >> np.uint64(64 - 17))
    owners.append(np.arange(len(words)))
    slots, owners = np.concatenate(slots).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.bincount(owners, minlength=len(words))


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Score of each language for each word."""
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    slots, counts = word_features(words)
    return np.add.reduceat(weights[slots & (len(weights) - 1)], np.cumsum(counts) - counts, axis=0)


def posteriors(scores: np.ndarray, change: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Posterior of every label of every word; texts stand one after another.

    Texts are cut into blocks. Products of the blocks' transfer matrices carry the state over block
    borders, so all blocks of all texts advance together, about STATES entries at a time, however long a text is.
    """
    labels = scores.shape[1]
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    word = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    block, step = np.repeat(first_block, lengths) + word // BLOCK, word % BLOCK
    edges = [*range(0, total, max(1, STATES // (BLOCK * labels))), total]
    table = np.exp(change - change.max())

    def norm(x, axes):
        return x / x.sum(axes, keepdims=True)

    def laid(a, b):
        """Words of blocks a to b, their weights by place and block, and which places hold one."""
        own = slice(*np.searchsorted(block, [a, b]))
        at = step[own], block[own] - a
        weight, filled = np.ones((BLOCK, b - a, labels)), np.zeros((BLOCK, b - a), bool)
        weight[at] = np.exp(scores[own] - scores[own].max(1, keepdims=True))
        filled[at] = True
        return own, at, weight, filled

    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for a, b in zip(edges, edges[1:]):
        _, _, weight, filled = laid(a, b)
        part = product[a:b]
        for t in range(BLOCK):
            live = filled[t]
            if not live.any():
                break
            moved = part[live] @ table * weight[t, live][:, None, :]
            part[live] = norm(moved, (1, 2))
    # state before each block, and what follows behind it, text by text
    start = np.full((total, labels), 1 / labels)
    finish = np.full((total, labels), 1 / labels)
    for k in range(1, int(blocks.max(initial=0))):
        at = (first_block + k)[blocks > k]
        start[at] = norm(np.einsum("bi,bij->bj", start[at - 1], product[at - 1]), 1)
        at = (first_block + blocks - 1 - k)[blocks > k]
        finish[at] = norm(np.einsum("bij,bj->bi", product[at + 1], finish[at + 1]), 1)
    found = np.empty(scores.shape)
    for a, b in zip(edges, edges[1:]):
        own, at, weight, filled = laid(a, b)
        forward = np.empty_like(weight)
        state = start[a:b]
        for t in range(BLOCK):
            new = norm(state @ table * weight[t], 1)
            state = np.where(filled[t][:, None], new, state)
            forward[t] = state
        state = finish[a:b]
        for t in range(BLOCK - 1, -1, -1):
            forward[t] *= state
            new = norm((weight[t] * state) @ table.T, 1)
            state = np.where(filled[t][:, None], new, state)
        found[own] = norm(forward[at], 1)
    return found


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    change: np.ndarray


def _sequence_gradient(scores: np.ndarray, change: np.ndarray, gold: np.ndarray, lengths: np.ndarray):
    """Gradients of the log-likelihood of label sequences, by words and by changes; what lies behind a sequence's length counts for nothing."""
    count, length, labels = scores.shape
    filled = np.arange(length) < lengths[:, None]
    table = np.exp(change - change.max())
    weight = np.exp(scores - scores.max(2, keepdims=True))
    forward, backward = np.empty_like(weight), np.ones_like(weight)
    state = np.full((count, labels), 1 / labels) @ table * weight[:, 0]
    forward[:, 0] = state / state.sum(1, keepdims=True)
    for t in range(1, length):
        state = forward[:, t - 1] @ table * weight[:, t]
        forward[:, t] = state / state.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        state = (backward[:, t + 1] * weight[:, t + 1]) @ table.T
        backward[:, t] = np.where(filled[:, t + 1, None], state / state.sum(1, keepdims=True), 1)
    word = forward * backward
    word /= word.sum(2, keepdims=True)
    # expected changes, summed over all places without a table for each
    both = filled[:, 1:]
    before, behind = forward[:, :-1][both], (weight[:, 1:] * backward[:, 1:])[both]
    pairs = table * ((before / (before @ table * behind).sum(1, keepdims=True)).T @ behind)
    truth = np.eye(labels)[gold]
    true_pairs = np.zeros((labels, labels))
    np.add.at(true_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    return (truth - word) * filled[:, :, None], true_pairs - pairs


def fit(sequences: list[tuple[str, list[str]]], epochs: int = 4, batch: int = 256, seed: int = 7) -> LanguageModel:
    """Weights from sequences of 1 to WINDOW words of one language each, a quarter of them spliced in pairs."""
    languages = sorted({language for language, _ in sequences})
    labels = len(languages)
    size = SLOTS
    while size * labels > WEIGHTS:
        size //= 2
    weights = np.zeros((size, labels), np.float32)
    change = np.zeros((labels, labels))
    if labels < 2:
        return LanguageModel(languages, weights, change)
    rng = np.random.default_rng(seed)
    of = {language: i for i, language in enumerate(languages)}
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in sequences for w in words}))}
    slots, counts = word_features(list(vocabulary))
    slots &= len(weights) - 1
    starts = np.cumsum(counts) - counts
    words, gold = np.zeros((2, len(sequences), WINDOW), np.int64)
    lengths = np.array([len(sequence) for _, sequence in sequences])
    for i, (language, sequence) in enumerate(sequences):
        words[i, : lengths[i]], gold[i] = [vocabulary[w] for w in sequence], of[language]
    spliced = rng.permutation(len(words))[: len(words) // 4]
    other = rng.permutation(len(words))[: len(words) // 4]
    # the first half of one and the second half of another
    plain, label, size = words.copy(), gold.copy(), lengths.copy()
    for i, j in zip(spliced.tolist(), other.tolist()):
        cut, behind = -(-size[i] // 2), size[j] // 2
        lengths[i] = cut + size[j] - behind
        words[i, cut: lengths[i]], gold[i, cut: lengths[i]] = plain[j, behind: size[j]], label[j, behind: size[j]]
    squares, change_squares = np.full(weights.shape, 1e-6, np.float32), np.full((labels, labels), 1e-6)
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(words)), max(1, len(words) // batch)):
            own, back = np.unique(words[at], return_inverse=True)
            size = counts[own]
            feature = slots[np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            score = np.add.reduceat(weights[feature], np.cumsum(size) - size, axis=0)
            by_word, by_change = _sequence_gradient(score[back].reshape(len(at), WINDOW, labels), change, gold[at], lengths[at])
            step = np.zeros((len(own), labels))
            np.add.at(step, back.ravel(), by_word.reshape(-1, labels))
            step = np.repeat(step, size, 0) / len(at)
            used, feature = np.unique(feature, return_inverse=True)
            total = np.stack([np.bincount(feature, step[:, j], len(used)) for j in range(labels)], 1).astype(np.float32)
            total -= 1e-5 * weights[used]
            squares[used] += total**2
            weights[used] += 0.1 * total / np.sqrt(squares[used])
            by_change = by_change / len(at) - 1e-5 * change
            change_squares += by_change**2
            change += 0.1 * by_change / np.sqrt(change_squares)
    return LanguageModel(languages, weights, change)


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, total_texts: int = TOTAL_TEXTS, languages: int = LANGUAGES) -> LanguageModel:
    """Learn from about `sample_texts` texts of each language outside the held-out fold, and about `total_texts` in all.

    Different texts are chosen by a hash, and at most WINDOWS sequences of each, spread over the whole text,
    come to the driver; a text of fewer than WINDOW words is one shorter sequence. Up to `languages` languages with
    a word are learned, those of most different texts (then by name), so a column of dirty labels does not end the
    driver; the model holds at most WEIGHTS weights. Rows with a null text or language, and texts without a word, teach nothing.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    )
    labelled = labelled.withColumn("hash", F.xxhash64("text"))
    # equal texts have equal hashes and count once
    known = labelled.select("lang", "hash").distinct().groupBy("lang").count()
    known = materialize(known.orderBy(F.desc("count"), "lang").limit(languages), "languages")
    count = known.count()
    each = min(sample_texts, max(1, total_texts // max(count, 1)))
    known = known.select("lang", F.least(F.lit(DRAWS), F.ceil(F.lit(DRAWS * each) / F.col("count"))).alias("cut"))
    chosen = labelled.join(broadcast_within(known, count), "lang").filter(F.pmod("hash", F.lit(DRAWS)) < F.col("cut")).select("lang", "text")

    def windows(batches):
        for part, texts in text_slices(batches):
            languages, found = [], []
            for text, language in zip(texts, part.column("lang").to_pylist()):
                words = WORD.findall(text.lower())
                last = max(0, len(words) - WINDOW)
                for at in sorted({last * i // (WINDOWS - 1) for i in range(WINDOWS)}) if words else ():
                    languages.append(language)
                    found.append(words[at: at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    rows = chosen.mapInArrow(windows, "lang string, words array<string>").distinct().collect()
    return fit(sorted((r["lang"], r["words"]) for r in rows))


class _Words(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


def identify(docs: DataFrame, model: LanguageModel, runs: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row, and with `runs` the runs of words of one language.

    Null texts and texts without a letter are `und` with score 0, and so is everything for a model without
    languages. A run has the first word, the word behind its last, and its language.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def work(batches):
        model = shared.value
        known, table = _Words(), np.zeros((0, len(model.languages)), np.float32)
        for part, texts in text_slices(batches):
            rows: list[int] = []
            lengths, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for i, text in enumerate(texts if model.languages else []):
                if text:
                    words = WORD.findall(text.lower())
                    letters[i] = any(any(map(str.isalpha, w)) for w in words)
                    if letters[i]:
                        lengths[i] = len(words)
                        rows.extend(map(known.__getitem__, words))
            table = np.concatenate([table, emissions(known.new, model.weights)])
            known.new.clear()
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            spans: list[list] = [[] for _ in texts]
            own = np.flatnonzero(lengths)
            if len(own):
                starts = np.cumsum(lengths[own]) - lengths[own]
                states = np.cumsum(-(-lengths[own] // BLOCK)) * len(model.languages) ** 2
                edges = [0, *(np.flatnonzero(np.diff(states // STATES)) + 1).tolist(), len(own)]
                word = np.concatenate([
                    posteriors(table[np.array(rows[starts[a]: starts[b - 1] + lengths[own[b - 1]]])], model.change, lengths[own[a:b]])
                    for a, b in zip(edges, edges[1:])
                ])
                mean = np.add.reduceat(word, starts, axis=0) / lengths[own][:, None]
                best[own], score[own] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                if runs:
                    label = word.argmax(1)
                    for i, a, n in zip(own.tolist(), starts.tolist(), lengths[own].tolist()):
                        edge = np.concatenate([[0], np.flatnonzero(np.diff(label[a: a + n])) + 1, [n]]).tolist()
                        spans[i] = [{"first": x, "end": y, "lang": model.languages[label[a + x]]} for x, y in zip(edge, edge[1:])]
            if len(known) > KNOWN_WORDS:
                known.clear()
                table = table[:0]
            names = [model.languages[b] if has else UNKNOWN for b, has in zip(best.tolist(), letters.tolist())]
            columns = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)]
            if runs:
                columns.append(pa.array(spans, run_type))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "runs"][: len(columns)])

    schema = f"doc_id {kind}, lang_pred string, score double"
    if runs:
        schema += ", runs array<struct<first: int, end: int, lang: string>>"
    return docs.select("doc_id", "text").mapInArrow(work, schema)
