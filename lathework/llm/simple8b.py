"""Token ids as binary files: Simple-8b words in blocks with offsets.

A file set is a Parquet table in the shared folder whose rows are byte records,
written by Spark's committer, so a lost executor or a repeated task leaves no
half of a file. One record holds whole documents, in ascending doc_id order:

    "S8B1" | u32 ids per block | u64 ids | u32 blocks | u32 words of each block
           | u64 words ...                                (all little-endian)

A word has its selector in the top four bits and values from the lowest bit up:

    selector  0   1   2   3   4   5   6   7   8  9  10 11 12 13 14 15
    values    240 120 60  30  20  15  12  10  8  7  6  5  4  3  2  1
    bits      0   0   1   2   3   4   5   6   7  8  10 12 15 20 30 60

Selector 15 is the escape: one id too wide for the others stands alone. Every
block starts at a word of its own; encoder and decoder work on all blocks of a
record at once, word by word, with numpy.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunked_bpe import ChunkedEncoder
from .shared import BLOCK_BYTES, discard, small_batches, spread, string_bytes, tidy, written

#: Fixed values of the format, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK_IDS = 4096
#: Characters of a text that ranges of rows are told apart by.
RANGE_CHARS = 32
MAGIC = b"S8B1"


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """One record of ids (each from 0 to 2^60 - 1)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n and int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    blocks = -(-n // block_ids)
    length = np.full(blocks, block_ids)
    if blocks:
        length[-1] = n - (blocks - 1) * block_ids
    # the selector with most values that takes all ids from each position on; what lies beyond a block counts as 0
    best = _best(ids, blocks, block_ids)[:n] if blocks else np.zeros(0, np.int8)
    # all blocks step from word to word together
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    steps_at, steps_block = [], []
    base = np.arange(blocks) * block_ids
    while len(live):
        place = base[live] + at[live]
        steps_at.append(place)
        steps_block.append(live)
        at[live] += COUNTS[best[place]]
        live = live[at[live] < length[live]]
    if not blocks:
        return MAGIC + struct.pack("<IQI", block_ids, 0, 0)
    place, block = np.concatenate(steps_at), np.concatenate(steps_block)
    order = np.argsort(place, kind="stable")
    place, block = place[order], block[order]
    selector = best[place].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    ends = base[block] + length[block]
    for s in range(2, 16):
        of = np.flatnonzero(selector == s)
        for k in range(COUNTS[s] if len(of) else 0):
            here = place[of] + k
            inside = here < ends[of]
            words[of[inside]] |= ids[here[inside]] << np.uint64(k * BITS[s])
    per_block = np.bincount(block, minlength=blocks).astype("<u4")
    return MAGIC + struct.pack("<IQI", block_ids, n, blocks) + per_block.tobytes() + words.astype("<u8").tobytes()


def _best(ids: np.ndarray, blocks: int, block_ids: int) -> np.ndarray:
    grid = np.zeros(blocks * block_ids, np.uint64 if int(ids.max()) >> 32 else np.uint32)
    grid[: len(ids)] = ids
    best = np.full(blocks * block_ids, 15, np.int8)
    fits = np.ones((blocks, block_ids + int(COUNTS[0])), bool)
    bits = -1
    for s in range(14, -1, -1):
        if BITS[s] != bits:
            bits = BITS[s]
            fits[:, :block_ids] = (grid >> grid.dtype.type(bits) == 0).reshape(blocks, block_ids)
        window, width = fits, 1
        while width < COUNTS[s]:  # ids from each position on that fit together: 1, 2, 4 ... COUNTS[s]
            step = min(width, int(COUNTS[s]) - width)
            window = window[:, : window.shape[1] - step] & window[:, step:]
            width += step
        taken = window[:, :block_ids]
        if not taken.any():
            break
        best[np.ascontiguousarray(taken).ravel()] = s
    return best


def decode(record: bytes) -> np.ndarray:
    """The ids of a record, as unsigned 64-bit integers."""
    if record[:4] != MAGIC:
        raise ValueError("not a Simple-8b record")
    block_ids, n, blocks = struct.unpack_from("<IQI", record, 4)
    per_block = np.frombuffer(record, "<u4", blocks, 20).astype(np.int64)
    words = np.frombuffer(record, "<u8", offset=20 + 4 * blocks)
    selector = (words >> np.uint64(60)).astype(np.int64)
    block, _ = spread(per_block)
    held = COUNTS[selector]
    upto = np.cumsum(held) - held
    first = np.concatenate([[0], np.cumsum(per_block)])[:-1]
    place = block * block_ids + upto - upto[first][block] if blocks else upto
    ends = np.minimum((block + 1) * block_ids, n)
    out = np.zeros(n, np.uint64)
    for s in range(2, 16):
        of = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s] if len(of) else 0):
            here = place[of] + k
            inside = here < ends[of]
            out[here[inside]] = (words[of[inside]] >> np.uint64(k * BITS[s])) & mask
    return out


_encoders: dict = {}


def encoder_of(path: str, keep_space: bool, mark: str) -> ChunkedEncoder:
    """One for each Python worker, kept while the worker is reused."""
    key = (path, keep_space)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkedEncoder(path, keep_space, mark)
    return _encoders[key]


def forget() -> None:
    _encoders.clear()


FILES = "shard int, record long, first_id long, n_ids long, doc_ids array<bigint>, lengths array<int>, payload binary"


def encoded(docs: DataFrame, tokenizer: str, mark: str) -> DataFrame:
    """doc_id, head (the text's first RANGE_CHARS characters), key (a hash of it), ids (little-endian, two bytes each where the vocabulary allows it, else four) of every row,
    as a written table: each text is read and encoded once, where it is."""
    small_batches(docs.sparkSession)
    kind = id_type(tokenizer)

    def work(batches):
        enc = encoder_of(tokenizer, False, mark)
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(3))
            for low, high, ids, at in enc.encode(data, offsets, BLOCK_BYTES):
                width, n = kind.itemsize, high - low
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((np.asarray(at, np.int64) - at[0]) * width), pa.py_buffer(np.ascontiguousarray(ids, kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, n) for k in range(3)), raw], names=["doc_id", "head", "key", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.substring("text", 1, RANGE_CHARS).alias("head"), F.xxhash64("text").alias("key"), "text")
    return written(rows.mapInArrow(tidy(work), "doc_id long, head string, key long, ids binary"), "simple8b-ids", compression="zstd")


@functools.lru_cache(maxsize=4)
def id_type(tokenizer: str) -> np.dtype:
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 1, mark: str = "<|endoftext|>", record_ids: int = 1 << 18) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order and returns the written files as a table.

    Rows of one doc_id are ordered by the beginning of their text and then by a hash of it; a null doc_id comes first; null text counts as
    empty, and an empty text has its end id alone. Other columns are not read. A record ends with
    the document that brings it to record_ids ids, so that no document spans two records.
    An empty table gives no record. Texts are encoded where they are, and their ids dealt out by ranges of doc_id, and of text
    beginnings and hashes where a doc_id has many rows: one shuffle of ids, two bytes for each.
    """
    kind = id_type(tokenizer)
    packed = encoded(docs, tokenizer, mark)
    rows = packed.repartitionByRange("doc_id", "head", "key").sortWithinPartitions("doc_id", "head", "key").select("doc_id", "ids")

    def shard(batches):
        shard_id, record, first = TaskContext.get().partitionId(), 0, 0
        held, names, sizes, total = [], [], [], 0

        def flush():
            nonlocal record, first, held, names, sizes, total
            payload = encode(np.concatenate(held))
            out = pa.RecordBatch.from_arrays([pa.array([shard_id], pa.int32()), pa.array([record], pa.int64()), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([np.concatenate(sizes).astype(np.int32)], pa.list_(pa.int32())), pa.array([payload], pa.binary())], names=["shard", "record", "first_id", "n_ids", "doc_ids", "lengths", "payload"])
            record, first = record + 1, first + total
            held, names, sizes, total = [], [], [], 0
            return out

        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary())
            if not len(raw):
                continue
            at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            ids = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)
            at = (at - at[0]) // kind.itemsize
            doc_ids = batch.column(0)
            low = 0
            while low < len(raw):  # as many documents as bring the record to its ids, or all that are left
                high = min(len(raw), low + 1 + int(np.searchsorted(at[low + 1 :] - at[low] + np.arange(1, len(raw) - low + 1), record_ids - total)))
                lengths = np.diff(at[low : high + 1]) + 1
                full = np.full(int(lengths.sum()), end_id, np.int64)
                owner, place = spread(lengths - 1)
                full[(np.cumsum(lengths) - lengths)[owner] + place] = ids[at[low] : at[high]]
                held.append(full)
                names += doc_ids.slice(low, high - low).to_pylist()
                sizes.append(lengths)
                total += len(full)
                if total >= record_ids:
                    yield flush()
                low = high
        if names:
            yield flush()

    files = written(rows.mapInArrow(tidy(shard), FILES), "simple8b", compression="zstd")
    discard(packed)
    return files


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; no record is shuffled.

    Null doc_ids are there as such, and rows that repeat as often as they were written; no record gives no row.
    Places of shards are broadcast: one row for each task that wrote, however long its records are.
    """
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    based = files.join(F.broadcast(shards.select("shard", F.coalesce("base", F.lit(0)).alias("base"))), "shard").select("doc_ids", "lengths", "payload", (F.col("base") + F.col("first_id")).alias("at"))

    def documents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                names, lengths = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                ids = decode(batch.column(2)[k].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.cast(pa.int64()), pa.array(ends - lengths + batch.column(3)[k].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(tidy(documents), "doc_id long, start long, n_tokens long, ids_crc32 long")
