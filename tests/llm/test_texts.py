"""Token ids, packing, fingerprints and repeats against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tunegrain.llm import fingerprints, grammar, packing, queries, repeats, suffixes
from tunegrain.llm.encode import TextEncoder, default_tokenizer
from tunegrain.runtime import materialize


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(plain):
    rng = random.Random(3)
    letters = "abAB .,\n\t'ſKİΣς́क़Å0½ß <|endoftext|>　ﬁ日 e"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", None, "Σ ΑΣ. é, K, İ, ſ.", "it's, we'll. 'll,", "x" * 5000]
    ids, lengths = TextEncoder(default_tokenizer()).encode(texts, 1)
    ends = np.cumsum(lengths)
    for text, a, b in zip(texts, ends - lengths, ends):
        assert ids[a:b].tolist() == [*plain(text), 1], text


def test_packing(spark, folder, texts, plain):
    rows = queries.op2(spark, folder).toPandas()
    expected = []
    for doc_id, text in texts.items():
        ids = [*plain(text), 1]
        expected += [(doc_id, k // 4096, k, len(ids[k: k + 4096]), crc(ids[k: k + 4096])) for k in range(0, len(ids), 4096)]
    assert sorted(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(expected)
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 4096
    bound = packing.lower_bound(np.bincount(rows.length, minlength=4097), 4096)
    assert rows.sequence_id.nunique() == bound and set(rows.least_sequences) == {bound}


def test_packing_meets_in_fewer_groups(spark, odd, empty):
    sizes = random.Random(1)
    pieces = spark.createDataFrame([(i, sizes.randint(1, 40)) for i in range(400)], "doc_id long, length long")
    rows = packing.pack_pieces(pieces, 64, 40).toPandas()
    assert len(rows) == 400 and rows.groupby("sequence_id").length.sum().max() <= 64
    assert rows.sequence_id.nunique() <= packing.lower_bound(np.bincount(rows.length, minlength=65), 64) + 2
    assert packing.pack_documents(odd).count() == len(ODD) and packing.pack_documents(empty).count() == 0


def test_packing_groups_stay_small(spark):
    """Pieces of more than half a sequence with much room: nothing can be exchanged, and no task gets all of them."""
    sizes = random.Random(2)
    pieces = spark.createDataFrame([(i, sizes.randint(33, 61)) for i in range(800)], "doc_id long, length long")
    rows = packing.pack_pieces(pieces, 64, 100).toPandas()
    assert len(rows) == rows.sequence_id.nunique() == 800
    assert rows.groupby(rows.sequence_id // 2**28).size().max() <= 200


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 31, rng.integers(1, 30))
        bins, offsets = packing.best_fit_decreasing(sizes, 30)
        assert np.bincount(bins, sizes).max() <= 30
        assert packing.lower_bound(np.bincount(sizes, minlength=31), 30) <= bins.max() + 1
    # three of 12 do not fit into 30, which only rounding shows
    assert packing.lower_bound(np.bincount([12] * 6, minlength=31), 30) == 3


def test_token_ids(spark, folder, texts, plain):
    rows = queries.op6(spark, folder).orderBy("doc_id").collect()
    expected, start = [], 0
    for doc_id, text in texts.items():
        ids = [*plain(text), 2]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in rows] == expected


def test_token_ids_of_odd_rows(odd, empty):
    placed = odd.filter("doc_id is not null")
    rows = grammar.encode_documents(placed).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2, 3, 3, 4, 4, 5] and rows[0].n_tokens == rows[1].n_tokens == 1
    assert grammar.encode_documents(empty).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_grammar_round_trip_and_random_access(letters):
    ids = np.random.default_rng(1).integers(0, letters, 5000).astype(np.uint32)
    block = grammar.Block(grammar.write_block(np.array([4, 9]), np.array([3000, 2000]), ids))
    assert (block.ids() == ids).all() and (block.document(1) == ids[3000:]).all()
    for start, count in ((0, 1), (4999, 1), (17, 400), (2990, 30)):
        assert (block.ids(start, count) == ids[start: start + count]).all()
    symbols, left, right = grammar.re_pair(ids, 4, 8)
    assert letters == 300 or len(symbols) < len(ids) / 1.5
    assert (grammar.expand(symbols, left, right) == ids).all() and len(grammar.re_pair(ids[:0])[0]) == 0


def test_grammar_leaves_no_pair_that_pays():
    rng = np.random.default_rng(2)
    copies = np.tile(rng.integers(0, 40_000, 300), 2000)
    rare = rng.permutation(np.repeat(rng.integers(40_000, 60_000, (300, 2)), 6, axis=0)).ravel()
    for ids in (copies, rare, np.zeros(70_000, int), rng.integers(0, 50, 30_000)):
        symbols, left, right = grammar.re_pair(ids.astype(np.uint32))
        assert (grammar.expand(symbols, left, right) == ids).all()
        count, last = {}, {}
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
            if last.get(pair, -2) < i - 1:  # occurrences that overlap count once
                count[pair], last[pair] = count.get(pair, 0) + 1, i
        assert max(count.values(), default=0) < grammar.LEAST_USES
    assert len(grammar.re_pair(copies.astype(np.uint32))[0]) < 20
    assert len(grammar.re_pair(rare.astype(np.uint32))[0]) <= len(rare) / 2


def test_grammar_of_rising_copies_is_quick_and_read_at_random():
    """Every pair occurs equally often: a hash settles them, so rounds, depth and rules' lengths stay small."""
    for n in (1000, 60_000):
        ids = np.tile(np.arange(n), 4).astype(np.uint32)
        start = time.process_time()
        symbols, left, right = grammar.re_pair(ids)
        assert time.process_time() - start < 5 and len(symbols) == 4 and len(left) == n - 1
        sizes = grammar.expansion_lengths(left, right)
        assert sizes.sum() < 40 * n and (grammar.expand(symbols, left, right, sizes) == ids).all()
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            looked.append(np.size(key))
            return np.asarray(self)[key]

    part = grammar.expand(symbols, left.view(Watched), right, sizes, 70_000, 70_010)
    assert (part == ids[70_000:70_010]).all() and sum(looked) < 400


def test_fingerprints(spark, folder, texts):
    rows = {r.doc_id: r for r in queries.op1(spark, folder).collect()}
    ids = sorted(texts, reverse=True)
    own = dict(zip(ids, fingerprints.as_text(*fingerprints.fingerprints([texts[i] for i in ids]))))
    for doc_id, after in zip(ids, [*ids[1:], ids[0]]):
        text, row = texts[doc_id], rows[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == own[doc_id] and row.edited_fingerprint == fingerprints.as_text(*fingerprints.fingerprints([edited]))[0]
        assert row.near_edited == pytest.approx(fingerprints.fingerprint_likeness(own[doc_id], row.edited_fingerprint))
        assert row.near_next == pytest.approx(fingerprints.fingerprint_likeness(own[doc_id], own[after]))
    assert sum(r.near_edited for r in rows.values()) > 20 * sum(r.near_next for r in rows.values())


def test_phrases_do_not_depend_on_their_place():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefg ") for _ in range(3000))
    names = [set(fingerprints.parse(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([len(t)]))[1].tolist()) for t in (text, "some other start " + text)]
    assert len(names[0] & names[1]) > 0.9 * len(names[0])
    assert fingerprints.fingerprint_likeness(*fingerprints.as_text(*fingerprints.fingerprints(["", ""]))) == 1


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert fingerprints.fingerprint_edits(empty).count() == 0 and fingerprints.fingerprint_documents(odd).count() == len(ODD)


def remove(rows, length=50):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1) if doc_id is not None else ():
            first[data[i: i + length]] = min(doc_id, first.get(data[i: i + length], doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1) if doc_id is not None else ():
            if first[data[i: i + length]] < doc_id:
                gone[i: i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, folder, texts):
    rows = [tuple(r) for r in queries.op3(spark, folder).collect()]
    assert sorted(rows, key=repr) == remove(texts.items())


def test_repeats_of_odd_rows(spark, odd, empty):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab é") for _ in range(60)) for _ in range(4)]
    rows = [(r[0], r[1]) for r in ODD] + [
        (rng.choice([6, 7, 8, 9, None]), rng.choice([None, "x" * 200, "".join(rng.choice(parts)[rng.randint(0, 30):] for _ in range(rng.randint(1, 4)))]))
        for _ in range(40)
    ]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(ODD):], "doc_id long, text string"))
    found = repeats.remove_repeats(df.withColumn("tag", F.lit("x"))).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == remove(rows)
    assert repeats.remove_repeats(empty).count() == 0


def test_many_texts_of_one_id_keep_their_own_bytes(spark):
    """Texts of one doc_id are told apart by all bits of a hash, whatever their number."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(80))
    rows = [(1, passage)]
    for i in range(1600):
        start, end = ("".join(rng.choice("klmnopqrst ") for _ in range(60)) for _ in range(2))
        rows.append((2, start + (passage if i % 2 else "") + end))
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == remove(rows)


def test_hot_anchors_are_split(spark, monkeypatch):
    """One passage in most texts, other text around it: its surroundings go to many shards, and the result stays the same."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij é") for _ in range(70))
    edges = ["".join(rng.choice("klmnopqrst ") for _ in range(60)) for _ in range(40)]
    rows = [(rng.randint(0, 150), rng.choice(edges)[rng.randint(0, 50):] + passage + rng.choice(edges)[:rng.randint(0, 60)]) for _ in range(200)]
    rows += [(rng.randint(0, 150), rng.choice(edges) * 2) for _ in range(40)] + [(None, passage), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sorted_tables = []
    monkeypatch.setattr(repeats, "materialize", lambda t, name: sorted_tables.append((name, materialize(t, name))) or sorted_tables[-1][1])
    found = repeats.remove_repeats(df, part_pieces=7).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == remove(rows)
    tables = dict(sorted_tables)
    assert tables["anchors"].filter("parts > 5").count() and tables["sorted"].filter("string is not null").count() > 100


def test_parts_of_an_anchor_meet_without_a_join(spark):
    rows = [(i, "".join(random.Random(i % 5).choice("klmnopqrst ") for _ in range(40)) + "0123456789abcdefghij" * 3 + str(i % 3) * 30) for i in range(40)]
    found = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.xxhash64("text")), part_pieces=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_window_groups():
    pieces, owners = [b"abcabc", b"bcab", b"ab"], np.array([4, 2, 1])
    windows, least, number, start, bounds = suffixes.window_groups(pieces, owners, 3)
    found = {w: (m, sorted(zip(number[a:b].tolist(), start[a:b].tolist()))) for w, m, a, b in zip(windows, least.tolist(), bounds[:-1], bounds[1:])}
    assert found == {b"abc": (4, [(0, 0), (0, 3)]), b"bca": (2, [(0, 1), (1, 0)]), b"cab": (2, [(0, 2), (1, 1)])}
    assert suffixes.window_groups([b"ab"], np.array([1]), 3)[0] == []


def test_surroundings_are_told_by_all_bits(monkeypatch):
    n = 4
    s = np.array([8, 8, 9, 8], np.uint64)  # the third differs in its last bit, the fourth in its anchor
    found = (np.arange(n), np.zeros(n, np.int64), np.array([5, 5, 5, 6], np.uint64), *[np.zeros(n, np.uint64)] * 2, s)
    monkeypatch.setattr(repeats, "anchors", lambda texts, length: found)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([0] * n, pa.int32()), pa.array(["x"] * n)], names=["doc_id", "tag", "text"])
    table = repeats._compare(pa.Table.from_batches(repeats._dealt(1, 50)([batch])))
    assert [d for d, ask in zip(table["doc_id"].to_pylist(), table["ask"].to_pylist()) if not ask] == [2]


def test_suffix_order():
    rng = np.random.default_rng(0)
    for size, letters in ((1, 3), (5, 2), (200, 2), (200, 4), (2000, 3), (2000, 250)):
        text = np.append(rng.integers(1, letters + 1, size), 0).astype(np.uint16)
        plain = text.tolist()
        assert suffixes.suffix_array(text, 10**6).tolist() == sorted(range(size + 1), key=lambda i: plain[i:])


def test_repeated_windows():
    rng = random.Random(0)
    for _ in range(40):
        base = [bytes(rng.choice(b"abcd") for _ in range(40)) for _ in range(3)]
        pieces = [b"".join(rng.choice(base)[rng.randint(0, 20):] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 10))]
        owners = np.array([rng.randint(0, 6) for _ in pieces])
        expected = {}
        for i, piece in enumerate(pieces):
            at = [a for a in range(len(piece) - 19) if any(owners[j] < owners[i] and piece[a: a + 20] in other for j, other in enumerate(pieces))]
            if at:
                expected[i] = (at[0], at[-1])
        found = suffixes.repeated_windows(pieces, owners, 20)
        assert {a: (b, c) for a, b, c in zip(*(x.tolist() for x in found))} == expected


MASK = 2**64 - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_toss(values):
    out = [values[0] & 1]
    for left, own in zip(values, values[1:]):
        bit = ((own ^ left) & -(own ^ left)).bit_length() - 1
        out.append(2 * bit + (own >> bit & 1))
    return out


def plain_parse(text):
    """Top name and names of one text, symbol by symbol."""
    step, run, length, power = (int(x) for x in (fingerprints._STEP, fingerprints._RUN, fingerprints._LENGTH, fingerprints._POWERS[1]))
    symbols, names, level = [plain_mix(ord(c) + step & MASK) for c in text], [], 0
    while len(symbols) > 1:
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        symbols = [s if n == 1 else plain_mix(s * run + n & MASK) for s, n in runs]
        label = plain_toss(plain_toss(plain_toss(symbols)))
        starts = [0, *(i for i in range(1, len(symbols) - 1) if label[i - 1] < label[i] > label[i + 1]), len(symbols)]
        phrases = [symbols[a:b] for a, b in zip(starts, starts[1:])]
        symbols = [plain_mix(sum(s * pow(power, i, 2**64) for i, s in enumerate(p)) + len(p) * length & MASK) for p in phrases]
        level += 1
        names += symbols if level >= fingerprints.FIRST_LEVEL else []
    return (symbols[0], [*names, symbols[0]]) if symbols else (0, [])


def test_parse_equals_a_plain_one(texts):
    rng = random.Random(9)
    own = [t[:3000] for t in list(texts.values())[:60]] + ["", "a", "aa", "aaaaab", "ab" * 50, "é日 ß" * 9]
    own += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    sizes = np.array([len(t) for t in own])
    top, names, owners = fingerprints.parse(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32), sizes)
    found = [[] for _ in own]
    for name, owner in zip(names.tolist(), owners.tolist()):
        found[owner].append(name)
    for i, text in enumerate(own):
        plain_top, plain_names = plain_parse(text)
        assert top[i] == plain_top and sorted(found[i]) == sorted(plain_names), text[:40]


def test_likeness_estimates_the_share_of_common_names(texts):
    """Against exact shares of names: 64 bins leave a deviation of at most 1/16."""
    rng = random.Random(10)
    base = [t[:4000] for t in texts.values() if len(t) > 1500][:40]
    errors = []
    for text in base:
        for share in (0.05, 0.3, 0.6, 0.9):
            cut = int(len(text) * share)
            other = text[:cut] + rng.choice(base)[cut:]
            tops, bins = fingerprints.fingerprints([text, other])
            a, b = (set(plain_parse(t)[1]) for t in (text, other))
            errors.append(float(fingerprints.likeness(tops[0], bins[0], tops[1], bins[1])) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.07 and np.abs(errors).max() < 0.3
