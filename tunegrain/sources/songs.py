"""Song tables: scan, write, merge, and compaction of many small files."""

from __future__ import annotations

import bz2
import gzip
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import orc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.runtime import broadcast_within, materialize
from tunegrain.schema import SONG_SCHEMA

TARGET_FILE_BYTES = 256 * 1024 * 1024


def read_songs(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", columns: Sequence[str] | None = None,
    schema: T.StructType | None = SONG_SCHEMA,
) -> DataFrame:
    """Scan a song table; with `columns` only those are read from a columnar file.

    The declared schema spares schema inference and reads all layouts: a column that a file
    lacks is null. `schema=None` takes the schema of the files. "avro" needs the spark-avro
    package on the class path.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path if isinstance(path, str) else list(path))
    return df.select(*columns) if columns else df


def write_songs(
    df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", mode: str = "errorifexists"
) -> None:
    df.write.format(fmt).option("compression", compression).mode(mode).save(path)


def output_files(spark: SparkSession, paths: Sequence[str], target_bytes: int, glob: str = "*") -> int:
    """Number of output files for the bytes of all files below `paths`.

    Sizes are summed in a scan that reads no contents; no list of files is made.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths))
    return max(1, -(-(sizes.agg(F.sum("length")).first()[0] or 0) // target_bytes))


def merge_tables(
    spark: SparkSession, paths: Sequence[str], out: str, fmt: str = "parquet", target_bytes: int = TARGET_FILE_BYTES,
) -> DataFrame:
    """Write the union of several tables with equal schemas as one table and return it."""
    if not paths:
        raise ValueError("no table to merge")
    schemas = [spark.read.format(fmt).load(path).schema for path in paths]
    for path, schema in zip(paths, schemas):
        if schema != schemas[0]:
            raise ValueError(f"schema mismatch in {path}")
    merged = spark.read.format(fmt).schema(schemas[0]).load(list(paths))
    files = output_files(spark, paths, target_bytes)
    # Coalescing joins input splits without a shuffle; every task still writes about one target file.
    write_songs(merged.coalesce(files), out, fmt)
    return spark.read.format(fmt).schema(schemas[0]).load(out)


def compact_small_files(
    spark: SparkSession, folder: str, glob: str, out: str, fmt: str = "parquet",
    schema: T.StructType | None = None, transform: Callable[[DataFrame], DataFrame] | None = None,
    target_bytes: int = TARGET_FILE_BYTES,
) -> DataFrame:
    """Read all matching files below `folder`, one or more records each, into few large files.

    A file comes through whole or not at all: files that break anywhere are left out, and
    `unreadable_files` names them. Without a `schema` the columns of all files are merged.
    `transform` turns the raw records into table rows, for example `segments.song_features`.
    """
    broken = materialize(unreadable_files(spark, folder, glob, fmt), "broken")
    source = _small_files(spark, folder, glob, fmt, schema)
    columns = source.columns
    tagged = source.withColumn("_file", _plain(F.col("_metadata.file_path")))
    raw = tagged.join(broadcast_within(broken, broken.count()), tagged["_file"] == broken["path"], "left_anti").select(*columns)
    if transform:
        # Features are far smaller than their input: files are sized by what comes out.
        rows = transform(raw).hint("rebalance")
    else:
        rows = raw.coalesce(output_files(spark, [folder], target_bytes, glob))
    write_songs(rows, out)
    return spark.read.schema(rows.schema).parquet(out)


def _plain(path: Column) -> Column:
    """One form for a file's path: readers give it encoded or not, with one slash or three before it."""
    bare = F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def _small_files(
    spark: SparkSession, folder: str, glob: str, fmt: str, schema: T.StructType | None
) -> DataFrame:
    reader = (
        spark.read.format(fmt)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", "true")
    )
    return (reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")).load(folder)


def _unzstd(data: bytes) -> bytes:
    """All frames of zstd-compressed bytes; a frame without its end is an error."""
    import zstandard

    parts = []
    while data:
        frame = zstandard.ZstdDecompressor().decompressobj()
        parts.append(frame.decompress(data))
        if not frame.eof:
            raise EOFError("a frame ends early")
        data = frame.unused_data
    return b"".join(parts)


def _avro_blocks(data: bytes) -> Iterator[bytes]:
    """The blocks of an Avro container; each has to end in the file's marker, and the last one with the file."""
    at = 4

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return (value >> 1) ^ -(value & 1)

    def run() -> bytes:
        nonlocal at
        size = number()
        part = data[at: at + size]
        if size < 0 or len(part) < size:
            raise EOFError("a value ends early")
        at += size
        return part

    if data[:4] != b"Obj\x01":
        raise OSError("not an Avro container")
    while pairs := number():  # the header's entries; a negative count has its size in bytes behind it
        if pairs < 0:
            number()
        for _ in range(2 * abs(pairs)):
            run()
    marker = data[at: at + 16]
    if len(marker) < 16:
        raise EOFError("no marker")
    at += 16
    while at < len(data):
        number()  # rows
        block = run()
        if data[at: at + 16] != marker:
            raise OSError("a block without its marker")
        at += 16
        yield block


_UNPACK = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".zst": _unzstd}


def _breaks(name: str, data: bytes, fmt: str) -> bool:
    """Whether a file's bytes cannot be read to their end."""
    try:
        for ending, unpack in _UNPACK.items():
            if name.endswith(ending):
                data = unpack(data)
        if fmt == "parquet":
            for _ in pq.ParquetFile(pa.BufferReader(data)).iter_batches():
                pass
        elif fmt == "orc":
            orc.ORCFile(pa.BufferReader(data)).read()
        elif fmt == "avro":
            for _ in _avro_blocks(data):
                pass
    except (pa.ArrowException, OSError, EOFError, ValueError, IndexError, zlib.error):
        return True
    except Exception as error:  # the class of another library, which may not be installed where nothing needs it
        if type(error).__module__.partition(".")[0] != "zstandard":
            raise
        return True
    return False


def unreadable_files(spark: SparkSession, folder: str, glob: str, fmt: str = "parquet") -> DataFrame:
    """(path): files below `folder` that break before their end: Parquet, ORC, Avro (block by block), and text
    packed by gzip, bzip2 or zstd. Text without packing has no end to miss.

    Every file is read whole in its task, as fits the many small files of this job.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)

    def work(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            bad = [n for n, data in zip(names, batch.column(1)) if _breaks(n, data.as_buffer().to_pybytes(), fmt)]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])

    return listing.load(folder).select(_plain(F.col("path")).alias("path"), "content").mapInArrow(work, "path string")


def write_matrix_csv(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A named matrix (one row and one column per feature) as CSV with a header."""
    matrix.coalesce(1).write.option("header", "true").mode(mode).csv(path)
