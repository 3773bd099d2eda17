from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunegrain.operators import cleaning, segments
from tunegrain.plans.corpus import compact_corpus
from tunegrain.schema import SEGMENTS_SCHEMA, SIGNATURE_WIDTH, SONG_SCHEMA
from tunegrain.sources import songs


def song(name, flat, conf=(1.0, 2.0, 3.0)):
    conf = None if conf is None else list(conf)
    return (name, conf, conf, conf, conf, conf, conf, flat, flat)


def rows_of(n, seed=1):
    return np.random.default_rng(seed).normal(size=(n, 12))


def by_hand(matrix):
    cov = np.cov(matrix, rowvar=False)
    return list(matrix.mean(axis=0)) + [cov[i, j] for i in range(12) for j in range(i, 12)]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        song("three", rows_of(3).ravel().tolist()),
        song("one", rows_of(1).ravel().tolist()),
        song("empty", [], []),
        song("ragged", rows_of(2).ravel().tolist() + [9.0]),
        song("none", None, None),
    ]
    return spark.createDataFrame(rows, SEGMENTS_SCHEMA)


def test_array_stats(spark, raw):
    rows = {r.song_id: r for r in segments.array_stats(raw, ["bars_confidence"], ["song_id"]).collect()}
    three = rows["three"]
    assert (three.bars_confidence_mean, three.bars_confidence_max) == (2.0, 3.0)
    assert three.bars_confidence_std == pytest.approx(0.816497, abs=1e-6)
    for name in ("empty", "none"):
        assert tuple(rows[name])[1:] == (None, None, None)


def test_signature(spark, raw):
    rows = {r.song_id: r.segments_timbre for r in segments.array_signature(raw, ["song_id"], ["segments_timbre"]).collect()}
    assert len(rows) == 5
    assert rows["three"] == pytest.approx(by_hand(rows_of(3)))
    assert rows["ragged"] == pytest.approx(by_hand(rows_of(2)))
    assert rows["one"][:12] == pytest.approx(list(rows_of(1)[0])) and rows["one"][12:] == [None] * 78
    assert rows["empty"] is None and rows["none"] is None
    gap = spark.createDataFrame([("gap", [None] + [1.0] * 23), ("full", [1.0] * 24)], "k string, a array<double>")
    found = dict(map(tuple, segments.array_signature(gap, ["k"], ["a"]).collect()))
    assert found["gap"] is None and found["full"] == [1.0] * 12 + [0.0] * 78
    diagonal = [12 + sum(12 - k for k in range(i)) for i in range(12)]
    assert all(rows["three"][i] >= 0 for i in diagonal)


def test_song_features_fit_the_song_schema(spark, raw):
    features = segments.song_features(raw)
    assert set(features.columns) <= set(SONG_SCHEMA.names)
    assert features.count() == 5 and "segments_loudness_max_max" not in features.columns


def test_describe_arrays(spark, raw):
    rows = dict(map(tuple, segments.describe_arrays(raw, ["song_id"], ["segments_timbre"]).collect()))
    assert rows == {"three": 36, "one": 12, "empty": 0, "ragged": 25, "none": None}


def test_compaction_skips_and_names_broken_files(spark, raw, tmp_path):
    folder = tmp_path / "in"
    for i, name in enumerate(["three", "one", "ragged"]):
        raw.filter(F.col("song_id") == name).coalesce(1).write.parquet(str(folder / f"a{i}" / "deep"))
    (folder / "broken.parquet").write_bytes(b"this is no table")
    (folder / "notes.txt").write_text("ignored")
    table = compact_corpus(spark, str(folder), str(tmp_path / "out"))
    assert sorted(r.song_id for r in table.collect()) == ["one", "ragged", "three"]
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("part")]) == 1
    broken = songs.unreadable_files(spark, str(folder), "*.parquet").collect()
    assert [r.path.rsplit("/", 1)[1] for r in broken] == ["broken.parquet"]


def test_merge_needs_equal_schemas(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    spark.range(5).write.parquet(a)
    spark.range(5, 9).write.parquet(b)
    spark.range(2).select(F.col("id").cast("string")).write.parquet(c)
    assert sorted(r.id for r in songs.merge_tables(spark, [a, b], str(tmp_path / "ab")).collect()) == list(range(9))
    with pytest.raises(ValueError, match="mismatch"):
        songs.merge_tables(spark, [a, c], str(tmp_path / "ac"))
    with pytest.raises(ValueError):
        songs.merge_tables(spark, [], str(tmp_path / "x"))


def test_read_songs_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "songs")
    songs.write_songs(spark.createDataFrame([("a", 1999, 1.0)], "song_id string, year int, tempo double"), path)
    whole = songs.read_songs(spark, path)
    assert whole.columns == SONG_SCHEMA.names and whole.first().energy is None
    plan = songs.read_songs(spark, path, columns=["year"]).filter("year > 0")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<year:int>" in plan and "GreaterThan(year,0)" in plan


def test_flatten_short_and_null_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, a array<double>")
    rows = cleaning.flatten_array(df, "a", 3, "x").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, 2.0, None), (2, None, None, None)]


def test_column_choice(spark):
    numeric = cleaning.numeric_columns(spark.createDataFrame([], SONG_SCHEMA))
    assert len(numeric) == 40
    assert len(cleaning.exclude_tokens(numeric)) == 17
    kept = cleaning.exclude_tokens(numeric, mode="token")
    assert "bars_confidence_mean" in kept and "key_confidence" in kept
    assert not {"artist_7digitalid", "artist_playmeid", "analysis_sample_rate"} & set(kept)
    assert SIGNATURE_WIDTH == 90


def test_low_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None)], "a double, b double, c double")
    kept, names = cleaning.drop_low_variance(df, ["a", "b", "c"])
    assert names == ["a"] and kept.columns == ["a"]
    with pytest.raises(ValueError):
        cleaning.drop_low_variance(df, ["b", "c"])


def test_drop_incomplete_also_drops_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (math.nan, 2.0), (None, 1.0), (1.0, None)], "a double, b double")
    assert cleaning.drop_incomplete(df, ["a"]).count() == 2
    assert cleaning.drop_incomplete(df).count() == 1
