"""Token ids of texts, by a public tokenizer file, inside Spark's Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa

# The memory of parts is emptied beyond this many, which bounds a worker's memory.
PARTS = 800_000
# A batch is worked on in slices of about this many characters.
SLICE_CHARS = 2_000_000


class _Parts(dict):
    """Part of a text -> row of the id table.

    A word in another case, or with one mark after it, points to its word's row or is put together from
    two rows; only what is left has to be encoded.
    """

    def __init__(self):
        super().__init__()
        self.rows = 0
        self.plain: list[str] = []  # ASCII letters only, so one word to the tokenizer, and its bytes are its letters
        self.plain_rows: list[int] = []
        self.words: list[str] = []  # other letters only
        self.word_rows: list[int] = []
        self.others: list[str] = []
        self.other_rows: list[int] = []
        self.pairs: list[tuple[int, int, int]] = []

    def __missing__(self, part: str) -> int:
        if part.isalpha():
            if part.isascii():
                plain = part.lower()
            else:
                plain = normalize("NFC", part).lower()
                # the tokenizer lower-cases letter by letter, without the final sigma
                if not plain.isalpha() or len(plain) != len(part) or "Σ" in part:
                    return self._other(part)
            row = self.get(plain)
            if row is None:
                row = self[plain] = self.rows
                self.rows += 1
                if plain.isascii():
                    self.plain.append(plain)
                    self.plain_rows.append(row)
                else:
                    self.words.append(plain)
                    self.word_rows.append(row)
            if plain is not part:
                self[part] = row
            return row
        if part[-1:] in (",", ".") and self._is_word(part[:-1]):
            word, mark = self[part[:-1]], self[part[-1]]
            row = self[part] = self.rows
            self.rows += 1
            self.pairs.append((row, word, mark))
            return row
        return self._other(part)

    def _other(self, part: str) -> int:
        row = self[part] = self.rows
        self.rows += 1
        self.others.append(part)
        self.other_rows.append(row)
        return row

    @staticmethod
    def _is_word(part: str) -> bool:
        return part.isalpha() and (part.isascii() or normalize("NFC", part).lower().isalpha())


class TextEncoder:
    """Ids of whole texts, equal to `Tokenizer.encode(text, add_special_tokens=False).ids`.

    Made for word tokenizers such as word_bpe: spaces and line ends are mere separators, letters
    are lower-cased and joined in runs, and the last id of a word is marked by a word-end
    suffix. Then a text's ids are the ids of its parts in a row, and a part that occurs again need
    not be encoded again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        suffix = self._tokenizer.model.end_of_word_suffix
        self._ends = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._ends[i] = bool(suffix) and token.endswith(suffix)
        self._clear()

    def _clear(self) -> None:
        self._parts = _Parts()
        self._starts = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of single words, many to a call, cut behind each word's last id."""
        texts = [" ".join(words[i: i + 1000]) for i in range(0, len(words), 1000)]
        encoded = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*encoded, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self._ends[flat]) + 1
        if len(ends) == len(words) and (not len(ends) or ends[-1] == len(flat)):
            return flat, np.diff(ends, prepend=0)
        return self._encode_each(words)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of lower-case ASCII words, which the model can take as they are."""
        split = self._tokenizer.model.tokenize
        encoded = [[token.id for token in split(word)] for word in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _encode_each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _learn(self) -> None:
        parts = self._parts
        rows = parts.rows - len(self._starts)
        self._starts = np.concatenate([self._starts, np.zeros(rows, np.int64)])
        self._sizes = np.concatenate([self._sizes, np.zeros(rows, np.int64)])
        for rows, new, encode in (
            (parts.plain_rows, parts.plain, self._encode_plain), (parts.word_rows, parts.words, self._encode_words), (parts.other_rows, parts.others, self._encode_each)
        ):
            if new:
                self._append(np.array(rows), *encode(new))
                new.clear()
                rows.clear()
        if parts.pairs:
            row, word, mark = np.array(parts.pairs, np.int64).T
            both = np.stack([word, mark], 1).ravel()
            self._append(row, self._gather(both), self._sizes[word] + self._sizes[mark])
            parts.pairs.clear()

    def _append(self, rows, flat: np.ndarray, sizes: np.ndarray) -> None:
        self._starts[rows] = len(self._flat) + np.cumsum(sizes) - sizes
        self._sizes[rows] = sizes
        self._flat = np.concatenate([self._flat, flat])

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of `rows`, one after another."""
        sizes = self._sizes[rows]
        ends = np.cumsum(sizes)
        shift = np.repeat(self._starts[rows] - (ends - sizes), sizes)
        return self._flat[shift + np.arange(len(shift))]

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by `end_id`, and the number of ids per text."""
        end = "\n"  # never a part, so its row can hold the end id
        if end not in self._parts:
            self._parts[end] = 0
            self._parts.rows = 1
            self._starts, self._sizes = np.zeros(1, np.int64), np.ones(1, np.int64)
            self._flat = np.array([end_id], np.uint32)
        row = self._parts.__getitem__
        rows: list[int] = []
        counts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(rows)
            if text:
                rows.extend(map(row, text.replace("\n", " ").split(" ")))
            rows.append(0)
            counts[k] = len(rows) - before
        self._learn()
        at = np.fromiter(rows, np.int64, len(rows))
        ids = self._gather(at)
        ends = np.cumsum(self._sizes[at])[np.cumsum(counts) - 1]
        lengths = np.diff(ends, prepend=0)
        if len(self._parts) > PARTS or len(self._flat) > 8 * PARTS:
            self._clear()
        return ids, lengths


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> TextEncoder:
    """One encoder for all tasks that a worker process runs, so that a part is encoded once per worker, not once per task."""
    return TextEncoder(path)


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_CHARS
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches cut into slices of about `size` bytes of text, with the texts as Python strings."""
    for batch in batches:
        texts = batch.column(column)
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            part = batch.slice(a, b - a)
            yield part, part.column(column).to_pylist()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
