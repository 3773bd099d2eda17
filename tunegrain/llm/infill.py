"""Fill-in-middle transformation by piece tables.

A document is a row of descriptors (buffer, start, length) over two buffers that never change: its
UTF-8 text and the sentinels. Cutting splits descriptors, an arrangement permutes them, the inverse
permutation restores the text, and digests are fed descriptor by descriptor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SENTINELS = (b"<P>", b"<S>", b"<M>")  # before the prefix, the suffix and the middle
# The parts prefix 0, suffix 1 and middle 2 in the order of each form.
ARRANGEMENTS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
_TEXT, _SENTINEL = 0, 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class PieceTable:
    """Descriptors (buffer, start, length) over a text and the sentinels; the buffers are never copied or changed."""

    _marks = memoryview(b"".join(SENTINELS))
    _mark_starts = np.cumsum([0, *map(len, SENTINELS)]).tolist()

    def __init__(self, text, pieces: Sequence[tuple[int, int, int]] | None = None):
        self.buffers = (memoryview(text), self._marks)
        self.pieces = [(_TEXT, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, places: Sequence[int]) -> list[list[tuple[int, int, int]]]:
        """The descriptors between `places` (ascending byte places of the table's content), one list for each part."""
        parts: list[list] = [[]]
        at, wanted = 0, iter([*places, None])
        place = next(wanted)
        for buffer, start, length in self.pieces:
            while place is not None and place < at + length:
                parts[-1].append((buffer, start, place - at))
                start, length, at = start + place - at, length - (place - at), place
                parts.append([])
                place = next(wanted)
            parts[-1].append((buffer, start, length))
            at += length
        while place is not None:
            parts.append([])
            place = next(wanted)
        return [[piece for piece in part if piece[2]] for part in parts]

    def arranged(self, cuts: Sequence[int], order: Sequence[int]) -> PieceTable:
        """Cut into prefix, middle and suffix; each part in `order` stands behind its sentinel."""
        prefix, middle, suffix = self.cut(cuts)
        parts = (prefix, suffix, middle)
        pieces = []
        for part in order:
            pieces += [(_SENTINEL, self._mark_starts[part], len(SENTINELS[part])), *parts[part]]
        return PieceTable(self.buffers[_TEXT], pieces)

    def restored(self, order: Sequence[int]) -> PieceTable:
        """The inverse: sentinels are found in the content, dropped, and the parts put back in their first order.

        The text between holds no sentinel and none can begin inside one, so the first found is the right one.
        """
        content = self.content()
        places = []
        at = 0
        for part in order:
            at = content.index(SENTINELS[part], at)
            places += [at, at + len(SENTINELS[part])]
            at = places[-1]
        found = self.cut(places)[2::2]
        inverse = np.argsort(order)
        prefix, suffix, middle = (found[i] for i in inverse.tolist())
        return PieceTable(self.buffers[_TEXT], [*prefix, *middle, *suffix])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start: start + length]

    def content(self) -> bytes:
        return b"".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


def unit_starts(text: np.ndarray) -> np.ndarray:
    """Byte places where units start: a run of ASCII letters is one unit, any other code point is one by itself."""
    letter = _LETTER[text]
    start = (text & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def _characters(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def _draws(doc_id: str, seed: int) -> list[int]:
    name = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(name[k: k + 8], 16) for k in (0, 8, 16, 24)]


def _byte_rows(column: pa.Array) -> Iterator[memoryview]:
    """UTF-8 bytes of each value, without a copy of the batch's buffer; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_pylist()
    for here, a, b in zip(valid, offsets.tolist(), offsets[1:].tolist()):
        yield data[a:b] if here else data[:0]


_FORM_COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output, output_sha256.

    Cuts and form are drawn from a digest of seed and doc_id (a null doc_id is drawn as an empty one), so repeated
    rows and retries give the same output. Null texts count as empty; texts that are empty or hold a sentinel are
    plain. Texts are taken whole; other columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def transform(batches):
        for batch in batches:
            rows: list[tuple] = []
            for name, raw in zip(batch.column("name").to_pylist(), _byte_rows(batch.column("text"))):
                text = np.frombuffer(raw, np.uint8)
                starts = unit_starts(text) if len(text) else np.zeros(0, np.int64)
                n = len(starts)
                h1, h2, h3, h4 = _draws(name or "", seed)
                table = PieceTable(raw)
                whole = bytes(raw)
                form, prefix_chars, middle_chars = "plain", None, None
                if n and h3 % 100 < 100 - plain_percent and not any(mark in whole for mark in SENTINELS):
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    cuts = [int(starts[u]) if u < n else len(text) for u in sorted((h1 % (n + 1), h2 % (n + 1)))]
                    prefix_chars, middle_chars = _characters(text[: cuts[0]]), _characters(text[cuts[0]: cuts[1]])
                    table = table.arranged(cuts, ARRANGEMENTS[form])
                rows.append((n, form, prefix_chars, middle_chars, table.content(), table.sha256()))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
            )

    narrow = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(transform, f"doc_id {kind}, {_FORM_COLUMNS}")


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """`rows` with restored_text and restored_sha256 added, from the columns `output` and `form` alone.

    Null outputs count as empty; a form that is null or plain leaves the output as it is. An output without the sentinels of its form is an error.
    Columns that have the added names are replaced.
    """
    added = [("restored_text", pa.string()), ("restored_sha256", pa.string())]

    def back(batches):
        for batch in batches:
            texts, digests = [], []
            for name, raw in zip(batch.column(form).to_pylist(), _byte_rows(batch.column(output))):
                table = PieceTable(raw)
                if name in ARRANGEMENTS:
                    table = table.restored(ARRANGEMENTS[name])
                texts.append(table.content())
                digests.append(table.sha256())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                names=[*batch.schema.names, *[n for n, _ in added]],
            )

    kept = rows.drop(*[n for n, _ in added])
    return kept.mapInArrow(back, StructType([*kept.schema.fields, *[StructField(n, StringType()) for n, _ in added]]))


INFILL_SQL = f"""
with unit as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
    sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as name from documents
), draw as (
  select *, len(units) as n, ('0x' || substr(name, 1, 8))::bigint as h1, ('0x' || substr(name, 9, 8))::bigint as h2,
    ('0x' || substr(name, 17, 8))::bigint as h3, ('0x' || substr(name, 25, 8))::bigint as h4 from unit
), part as (
  select doc_id, text, n, case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {100 - PLAIN_PERCENT} then 'plain'
    when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form,
    array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') as prefix,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as middle,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') as suffix from draw
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256 from part
"""
