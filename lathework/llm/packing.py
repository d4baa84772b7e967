"""Packing: shortest-pack-first over the length histogram.

Documents become pieces of at most `size` ids; the histogram of piece lengths (at
most `size` bins, whatever the corpus) is packed on the driver, longest first,
each length going to the open packs with most room, to the same ones again while
these have most room. Equal packs are one pattern with a count, so the work doesn't grow with the corpus. Each pattern's places
are then intervals of ranks of a length, and pieces join them by their rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small_batches, spread, string_bytes, tidy, written
from .simple8b import encoder_of, forget

SIZE = 1024
#: Rows of a length that are ranked together, about; a longer list of equal lengths is dealt over several groups.
RANK_ROWS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, mark: str = "<|endoftext|>") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: whole pieces of `size` ids, then the rest.

    Null text counts as empty: its piece is the end id alone. Repeated rows give pieces each; `again`
    numbers equal pieces that a task sees together, so that these can be told apart.
    """

    small_batches(docs.sparkSession)

    def cut(batches):
        enc = encoder_of(tokenizer, True, mark)
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            doc_ids = batch.column(0)
            for low, high, ids, at in enc.encode(data, offsets):
                tokens = np.diff(at) + 1
                full = np.full(len(ids) + high - low, end_id, "<u4")
                first = np.cumsum(tokens) - tokens
                owner, place = spread(np.diff(at))
                full[first[owner] + place] = ids
                doc, k = spread(-(-tokens // size))
                start = k * size
                length = np.minimum(size, tokens[doc] - start)
                raw, begin = full.tobytes(), (first[doc] + start) * 4
                crc = [zlib.crc32(raw[b:e]) for b, e in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                names = doc_ids.slice(low, high - low).fill_null(-1).to_numpy()
                again = _times_before(np.stack([names[doc], start, crc]))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(low, high - low).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(tokens[doc], pa.int64()), pa.array(again, pa.int32())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "again"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(cut, forget), f"{PIECES}, again int")


def _times_before(columns: np.ndarray) -> np.ndarray:
    """For each place, how many places before it have the same values."""
    order = np.lexsort(columns)
    rows = columns[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), np.int64)
    out[order] = np.arange(len(order)) - first
    return out


def strategy(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each pattern: all pieces of the histogram, each once."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # room -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(size, length - 1, -1):
            packs = open_packs.get(room, [])
            while packs and left:
                count, lengths = packs[-1]
                take = min(count, left)
                if take == count:
                    packs.pop()
                else:
                    packs[-1][0] -= take
                open_packs[room - length].append([take, (*lengths, length)])  # its turn comes again further down
                left -= take
            if not left:
                break
        # what no open pack takes starts new ones; a pack takes this length as often as it fits
        each = size // length
        while left:
            k = min(each, left)
            count = left // k
            open_packs[size - k * length].append([count, (length,) * k])
            left -= count * k
    return [(count, lengths) for packs in open_packs.values() for count, lengths in packs]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length that go to a place of a pattern."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Every piece of docs with its sequence_id and offset; sequences hold at most `size` ids, gapless from 0.

    Pieces are written to the shared folder once (ids are not), as the histogram and the ranks
    must see the same rows. A length's pieces are dealt by a hash over as many groups as its count asks
    for, and ranks count the groups first, so no length, however frequent, is ordered in one task. An empty
    table gives no piece.
    """
    made = written(pieces(docs, tokenizer, end_id, size), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    table = pa.table([pa.array(x, pa.int64()) for x in zip(*places(strategy(histogram, size)), strict=True)] or [pa.array([], pa.int64())] * 5, names=["length", "low", "high", "sequence", "offset"])
    # at most `size` values, by length
    deals = F.split(F.lit(",".join(str(-(-histogram.get(k, 1) // RANK_ROWS)) for k in range(1, size + 1))), ",").cast("array<int>")
    key = F.when(F.element_at(deals, F.col("length").cast("int")) > 1, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "again"), F.element_at(deals, F.col("length").cast("int")))).otherwise(0)
    dealt = made.withColumn("dealt", key.cast("long"))
    sizes = dealt.groupBy("length", "dealt").agg(F.count("*").alias("n"))
    bases = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("dealt")) - F.col("n")).select("length", "dealt", "base")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "dealt").orderBy("doc_id", "start", "ids_crc32", "again")) - 1)
    ranked = ranked.join(bases, ["length", "dealt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the table of places has at most a few rows for each length and place in a pack: bounded by `size`, never by the corpus
    lengths, low, _, sequence, offset = (table.column(i).to_numpy() for i in range(5))
    order = np.lexsort((low, lengths))
    lengths, low, sequence, offset = lengths[order], low[order], sequence[order], offset[order]

    def put(batches):
        keys = lengths * (1 << 44) + low
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence[at] + rank - low[at], pa.int64()), pa.array(offset[at], pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(tidy(put), f"{PIECES}, sequence_id long, offset long")
