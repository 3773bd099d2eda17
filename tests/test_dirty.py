"""Ordinary dirty input: gaps, ragged lists, broken files, repeated keys, infinite values."""

from __future__ import annotations

import bz2
import gzip
import json

import numpy as np
import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tunegrain.operators import features, quantiles, ranking, ridge, training
from tunegrain.sources import songs


def test_ragged_features_are_an_error(spark):
    ragged = spark.createDataFrame([([1.0, 2.0, 3.0], 1.0), ([1.0], 2.0), ([1.0, 2.0], 3.0)], "x array<double>, y double").coalesce(1)
    with pytest.raises(PythonException, match="feature lists of 1 to 3 values"):
        ridge.fit_ridge(ragged, "x", "y")


def test_rows_with_gaps_teach_nothing(spark):
    rows = [([float(i), float(i % 3)], 2.0 * i + 1.0) for i in range(20)]
    gaps = [([1.0, None], 9.0), ([float("nan"), 1.0], 9.0), ([1.0, 1.0], None), ([1.0, 1.0], float("nan")), (None, 9.0)]
    schema = "x array<double>, y double"
    clean, dirty = (ridge.fit_ridge(spark.createDataFrame(r, schema), "x", "y") for r in (rows, rows + gaps))
    assert np.allclose(clean.weights, dirty.weights) and np.isclose(clean.intercept, dirty.intercept)


def test_null_labels_are_no_class(spark):
    rows = spark.createDataFrame([(0.0, 1970), (0.1, 1970), (5.0, 1999), (5.1, 1999), (9.0, None)], "v double, year int")
    table = features.assemble(["v"]).transform(rows)
    scored = training.fit_logistic(table, label_col="year").transform(table)
    assert {r.prediction for r in scored.collect()} == {"1970", "1999"}


@pytest.mark.parametrize("values", [
    np.concatenate([np.linspace(-3, 3, 500), [np.inf] * 300, [-np.inf] * 10, [np.nan] * 5]),
    np.exp(np.linspace(-300, 300, 901)), np.array([1e308, -1e308] * 60 + list(range(60))), np.array([np.inf, 1.0, 2.0, -np.inf]),
])
def test_percentiles_of_heavy_tails_and_infinities(spark, monkeypatch, values):
    monkeypatch.setattr(quantiles, "SORT_ROWS", 40)
    probs = [0.0, 0.005, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    found = {r.prob: r.value for r in quantiles.exact_percentiles(df, ["a"], probs).collect()}
    known = np.sort(values[~np.isnan(values)])
    for prob in probs:
        at = prob * (len(known) - 1)
        a, b = known[int(np.floor(at))], known[int(np.ceil(at))]
        expected = a if a == b or at == int(at) or np.isinf(a) else b if np.isinf(b) else a + (b - a) * (at - np.floor(at))
        assert found[prob] == pytest.approx(expected, rel=1e-12)


def _json(path, rows, cut=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = gzip.compress("\n".join(json.dumps({"a": i, "b": "x" * 20 + str(i)}) for i in range(rows)).encode())
    path.write_bytes(data[:cut])


def test_half_a_file_is_left_out_and_named(spark, tmp_path):
    folder = tmp_path / "with space"
    _json(folder / "one%25.json.gz", 1000)
    _json(folder / "deep er" / "two.json.gz", 500)
    _json(folder / "half one.json.gz", 20_000, 30_000)
    broken = [r.path for r in songs.unreadable_files(spark, str(folder), "*.json.gz", "json").collect()]
    assert [b.rsplit("/", 1)[1] for b in broken] == ["half one.json.gz"]
    made = songs.compact_small_files(spark, str(folder), "*.json.gz", str(tmp_path / "out"), "json", "a long, b string")
    assert made.count() == 1500


def test_columns_of_all_files_come_through(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in" / "a"))
    spark.range(2).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "in" / "b"))
    made = songs.compact_small_files(spark, str(tmp_path / "in"), "*.parquet", str(tmp_path / "out"))
    assert made.columns == ["id", "more"] and made.filter("more is null").count() == 3


def test_merging_is_sized_by_the_files_that_are_read(spark, tmp_path):
    for i in range(2):
        spark.range(4000).repartition(4).write.option("compression", "gzip").csv(str(tmp_path / f"t{i}"))
    merged = songs.merge_tables(spark, [str(tmp_path / "t0"), str(tmp_path / "t1")], str(tmp_path / "out"), "csv", target_bytes=10_000)
    assert merged.count() == 8000 and len(list((tmp_path / "out").glob("part-*"))) > 1


def test_ranks_are_dense_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(5)
    rows = ranking.with_rank(df, ["v"]).collect()
    assert all(r.v == r["rank"] for r in rows) and len(rows) == 1000


def _avro(rows: int) -> bytes:
    """A container of `rows` blocks with one long each, put together by hand."""
    def number(n):
        n, out = n << 1, b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def run(data):
        return number(len(data)) + data

    head = b"Obj\x01" + number(2) + run(b"avro.schema") + run(b'"long"') + run(b"avro.codec") + run(b"null") + number(0)
    marker = bytes(range(16))
    return head + marker + b"".join(number(1) + run(number(300 + i)) + marker for i in range(rows))


def test_packed_and_avro_files_come_whole_or_are_named(spark, tmp_path):
    text = "".join(f'{{"a": {i}, "b": "x{i * i}"}}\n' for i in range(2000)).encode()
    packed = {
        "json.bz2": bz2.compress(text), "json.zst": zstandard.ZstdCompressor().compress(text), "json.gz": gzip.compress(text), "avro": _avro(40),
    }
    for ending, data in packed.items():
        folder = tmp_path / ending
        folder.mkdir()
        (folder / f"whole.{ending}").write_bytes(data)
        (folder / f"half.{ending}").write_bytes(data[: len(data) // 2])
        (folder / f"short.{ending}").write_bytes(data[:-3])
        fmt = "avro" if ending == "avro" else "json"
        broken = [r.path.rsplit("/", 1)[1] for r in songs.unreadable_files(spark, str(folder), f"*.{ending}", fmt).collect()]
        assert sorted(broken) == [f"half.{ending}", f"short.{ending}"]
    two = tmp_path / "two.json.zst"
    two.write_bytes(packed["json.zst"] * 2)
    assert songs.unreadable_files(spark, str(tmp_path), "two.*", "json").count() == 0
    made = songs.compact_small_files(spark, str(tmp_path / "json.bz2"), "*.bz2", str(tmp_path / "out"), "json", "a long, b string")
    assert made.count() == 2000
