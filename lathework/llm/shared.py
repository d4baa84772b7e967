"""What several operators of this subpackage need: tables in the shared folder and text batches.

Text batches are Arrow string columns seen as one byte array with offsets, so
that words and their hashes come from a few numpy passes, with no Python object
for each word.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Bytes of text that one numpy pass takes together; a longer text goes alone.
BLOCK_BYTES = 700_000


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: it survives lost executors and cuts the lineage. compression: a Parquet codec
    in place of the session's, for what the usual one doesn't make smaller."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; a returned plan's tables stay with the shared folder."""
    for df in tables:
        if path := df.__dict__.pop("_written_to", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for none to be a column of df."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Arrow batches of at most so many rows, and bytes where Spark can: long texts would make default ones large.
    A session's smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).strip("bB").lstrip("-").isdigit() or int(str(now).strip("bB")) <= 0 or int(str(now).strip("bB")) > most:
            spark.conf.set(key, str(most))


def tidy(work, after=None):
    """A function over Arrow batches that gives memory back when its task ends: Python workers stay for later tasks.

    after: called at the end of a task, to drop what the worker would keep.
    """

    def tidied(batches):
        try:
            yield from work(batches)
        finally:
            if after:
                after()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


#: Bytes of a key table that may be broadcast, and what a row takes beside its columns in a hash table.
BROADCAST_BYTES, ROW_BYTES = 48 << 20, 32
#: Least and most bits of a bitmap of keys (32 MB at most, whatever the corpus), and bits for each key between.
LEAST_BITS, MOST_BITS, KEY_BITS = 1 << 15, 1 << 28, 16
_BITMAP = 1 << 15  # bits of one value of bitmap_construct_agg


def few_enough(keys: DataFrame, width: int = 16, most: int | None = None) -> bool:
    """Whether a written table is small enough to broadcast; counts it. width: bytes of a row's columns."""
    return keys.count() * (width + ROW_BYTES) <= (BROADCAST_BYTES if most is None else most)


def bitmap(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits) of the 64-bit hashes of a written table's one column, and the bits in all; of a proven size."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < KEY_BITS * hashes.count():
        bits *= 2
    place = F.pmod(F.col(quoted(hashes.columns[0])), F.lit(bits))
    made = hashes.select((place / _BITMAP).cast("long").alias("bucket"), (place % _BITMAP).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return made, bits


def in_bitmap(rows: DataFrame, hashed: Column, made: tuple[DataFrame, int], held: bool = True) -> DataFrame:
    """The rows whose hash is in the bitmap (held=False: isn't), by a broadcast of its fixed size; no shuffle.

    Every key's rows are held; of other rows some are too, the more the fuller the bitmap is.
    """
    table, bits = made
    place = F.pmod(hashed, F.lit(bits))
    bit = (place % _BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring(table["bits"], (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(table), ((place / _BITMAP).cast("long") == table["bucket"]) & (F.getbit(byte, bit % 8) == 1), "left_semi" if held else "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# text batches


def string_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets of each row and the end, valid rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(ends[0]), int(ends[-1])
    text = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return text, ends - low, valid


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """(first row, end row) of runs of rows of at most so many bytes; a longer row is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power before each position; spans' hashes are differences of these."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(run))
    return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: all ASCII but letters and digits
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes that aren't `between` words (by default
    [^\\x20\\x09-\\x0D]+); words don't cross rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~between[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per owner: the owner of each item and the item's place with its owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]
