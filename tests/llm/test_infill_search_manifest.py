"""Fill-in-middle, exact search and the manifest against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import connect, difference
from tunegrain.llm import infill, manifest, queries, search


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_exact_search", "op13_manifest"])
def test_equal_to_sql(spark, folder, name):
    q = queries.LLM_QUERIES[name]
    assert difference(q.run(spark, folder), connect(folder), q.sql) is None


def infilled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    name = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * i: 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_of_odd_rows(spark, odd, empty):
    rng = random.Random(7)
    letters = "aZ é\n<>PSM日𝄞́"
    rows = [(rng.choice([None, i]), "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(1000, "<P>"), (1001, "a<S>b"), (1002, "x" * 300_000 + " y " * 100_000), (1002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("output", F.lit(1))
    found = infill.restore(infill.fill_in_middle(df)).collect()
    expected = [infilled(*r) for r in rows]
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(expected, key=repr)
    for r in found:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(r.restored_text.encode()).hexdigest()
    assert sorted(((r.doc_id, r.restored_text) for r in found), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(odd).count() == odd.count() and infill.restore(infill.fill_in_middle(empty)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40).filter(lambda t: not any(s in t for s in infill.SENTINELS)), st.data())
def test_piece_tables_come_back(text, data):
    cuts = sorted(data.draw(st.tuples(*[st.integers(0, len(text))] * 2)))
    for order in infill.ARRANGEMENTS.values():
        table = infill.PieceTable(text).arranged(cuts, order)
        parts = (text[: cuts[0]], text[cuts[1]:], text[cuts[0]: cuts[1]])
        assert table.content() == b"".join(infill.SENTINELS[p] + parts[p] for p in order)
        assert table.sha256() == hashlib.sha256(table.content()).hexdigest() and table.buffers[0] == text
        assert table.restored(order).content() == infill.PieceTable(table.content()).restored(order).content() == text
    places = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=5)))
    parts = infill.PieceTable(text).cut(places)
    assert [b"".join(text[s: s + n] for _, s, n in part) for part in parts] == [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


def products(rows, k=5, every=50):
    used = []
    for i, (key, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, key, [math.floor(256 * x) for x in v]))
    out = []
    for i, key, q in used:
        if key is None or key % every:
            continue
        scores = [(max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), other) for j, other, c in used if j != i]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(key, r + 1, other, s) for r, (s, other) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def test_search_of_odd_rows(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([0.0, 0.0, 0.0, 0.25, -0.5, 0.0039, 1.0]) for _ in range(rng.choice([3, 8, 8, 8]))]) for i in range(300)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)]  # ties beyond k
    rows += [(50, None), (50, [0.5, None]), (100, [float("nan"), 1.0]), (150, [float("inf")]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [3.0] * 8), (None, [3.0] * 8)]
    rows += [(-50, [3e4, 1.0]), (500, []), (501, [-2e4] * 3), (550, [1e30, -1e30]), (551, [1e30]), (552, [-1e30, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as row", "2 as id", "3 as vector", "4 as chunk", "5 as first")
    exact = [(key, v and [x if x is None else float(np.float32(x)) for x in v]) for key, v in rows]
    expected = products(exact)
    for chunk_blocks, candidates, queries_each in ((1, 7, 2), (16, 64, 4), (2, 2048, 1024)):
        found = search.top_products(df.repartition(3), chunk_blocks=chunk_blocks, candidate_rows=candidates, query_rows=queries_each)
        assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert search.top_products(df.filter("false")).count() == 0 and search.top_products(df.filter("vec_id % 50 <> 0")).count() == 0
    assert sorted(map(tuple, search.top_products(df.filter("vec_id = 500")).collect())) == []


def test_selection_by_partition():
    rng = np.random.default_rng(0)
    for size in (1, 4, 5, 6, 40):
        scores = rng.integers(0, 4, size)
        best = sorted(range(size), key=lambda i: (-scores[i], i))[:5]
        assert search.select(scores, 5).tolist() == sorted(best)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root and, for each leaf, the (before, after) siblings of its levels."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = nodes[place ^ 1] if place ^ 1 < len(nodes) else ""
            paths[i].append((other, "") if place % 2 else ("", other))
        nodes, at = [digest(*nodes[i: i + 2]) for i in range(0, len(nodes), 2)], [p // 2 for p in at]
    return nodes[0], paths


def proofs(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    def leaf(*fields):
        return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    groups = {}
    for r in rows:
        other = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
            other = (*r[:3], r[3] + 1, r[4])
        groups.setdefault(r[2], []).append((r[0], leaf(*r), leaf(*other)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, below = [], []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = tree([x[1] for x in groups[g]])
        subroots.append(root)
        below.append(paths)
    root, above = tree(subroots) if subroots else (None, [])
    out = []
    for g, sub, paths, up in zip(order, subroots, below, above):
        for (doc_id, own, other), path in zip(groups[g], paths):
            at = other
            for before, after in [*path, *up]:
                at = digest(before, at, after)
            out.append((doc_id, own, sub, root, digest(*[b + a for b, a in [*path, *up]]), at, at == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [2, 8])
def test_manifest_of_odd_rows(spark, bits):
    rng = random.Random(bits)
    sizes = {None: 5, "": 1, "a": 2, "ab": 3, "Z": 4, "é": 17, "日": 1, "z9": 8, "hot": 41}
    rows = []
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((rng.choice([None, *range(60)]), rng.choice([None, "", "s:1"]), lang, rng.choice([None, 0, 12, 2**40]), rng.choice([None, "", "é\n", "text"])))
    rows += [rows[0]] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.selectExpr("*", "1 as tree", "2 as node", "'x' as leaf", "3 as _rank", "4 as _copy", "5 as n")
    found = [tuple(r) for r in manifest.document_proofs(df.repartition(5), bits).drop("path").collect()]
    assert sorted(found, key=repr) == proofs(rows)
    assert {r[6] for r in found} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.document_proofs(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "s", "l", 3, "abc")], [(2, None, None, None, None), (2, None, None, None, None)]):
        found = [tuple(r) for r in manifest.document_proofs(spark.createDataFrame(rows, schema)).drop("path").collect()]
        assert sorted(found, key=repr) == proofs(rows)
