"""Table layouts. All columns are nullable: unknown values are common in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the song table.
CONFIDENCE_GROUPS = ["bars", "beats", "sections", "segments", "tatums"]
SEGMENT_ARRAYS = ["segments_pitches", "segments_timbre"]
SEGMENT_PARTS = ["segments_pitches_mean", "segments_pitches_std", "segments_timbre_mean", "segments_timbre_std"]
ANALYSIS_INTS = ["analysis_sample_rate", "key", "mode", "time_signature"]
ANALYSIS_DOUBLES = [
    "danceability", "duration", "end_of_fade_in", "energy", "key_confidence", "loudness",
    "mode_confidence", "start_of_fade_out", "tempo", "time_signature_confidence",
]
METADATA_INTS = ["artist_7digitalid", "artist_playmeid", "release_7digitalid", "track_7digitalid"]
METADATA_DOUBLES = [
    "artist_familiarity", "artist_hotttnesss", "artist_latitude", "artist_longitude", "song_hotttnesss",
]
FACT_STRINGS = ["song_id", "title", "release", "artist_name"]

SEGMENT_DIMS = 12
SIGNATURE_WIDTH = SEGMENT_DIMS + SEGMENT_DIMS * (SEGMENT_DIMS + 1) // 2


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name in names]


def _summary_names() -> list[str]:
    stats = [f"{group}_confidence_{stat}" for group in CONFIDENCE_GROUPS for stat in ("mean", "std", "max")]
    return stats + ["segments_loudness_max_mean", "segments_loudness_max_std"]


_DOUBLES = T.ArrayType(T.DoubleType(), True)

# One superset of the three layouts in use: string facts, scalars, 12-wide parts, 90-wide signatures.
SONG_SCHEMA = T.StructType(
    _fields(FACT_STRINGS, T.StringType())
    + _fields(_summary_names(), T.DoubleType())
    + _fields(SEGMENT_ARRAYS + SEGMENT_PARTS, _DOUBLES)
    + _fields(ANALYSIS_INTS, T.IntegerType())
    + _fields(ANALYSIS_DOUBLES, T.DoubleType())
    + _fields(METADATA_INTS, T.IntegerType())
    + _fields(METADATA_DOUBLES, T.DoubleType())
    + _fields(["year"], T.IntegerType())
)

# Raw analysis arrays as they arrive, one record per song.
SEGMENTS_SCHEMA = T.StructType(
    _fields(["song_id"], T.StringType())
    + _fields([f"{group}_confidence" for group in CONFIDENCE_GROUPS] + ["segments_loudness_max"], _DOUBLES)
    + _fields(SEGMENT_ARRAYS, _DOUBLES)
)


def segment_columns(df: DataFrame) -> dict[str, int]:
    """Segment array columns present in `df` with their fixed widths, for either layout."""
    widths = {name: SIGNATURE_WIDTH for name in SEGMENT_ARRAYS}
    widths.update({name: SEGMENT_DIMS for name in SEGMENT_PARTS})
    return {name: width for name, width in widths.items() if name in df.columns}
