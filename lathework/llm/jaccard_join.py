"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

Shingles have one global order, rare ones first by a sketch of counts over all
documents. If two sets reach the similarity, their prefixes lengthened to need l
shared tokens share l of them, for every l. Each document picks the l of least
estimated cost (entries of its prefix plus verification of its candidates); a pair
is held to the smaller l of the two, and verified on whole sets.

Documents of equal sets are one class. Only links matter for components, so each
token's classes are first linked to the most typical class of the token's list
(one candidate each, not all pairs); pairs within one component are then settled.
What remains, the classes of a list outside the leader's component against all of
the list, is joined in full, so that no link between components is lost. Links
are verified beside their leader, and a leader's partners are dealt over several tasks.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import labels
from .shared import LOWER, bitmap, discard, few_enough, in_bitmap, mixed, row_blocks, running_hash, small_batches, span_hash, string_bytes, tidy, unused, word_spans, written

#: The sketch of counts has a bucket for so many bytes of the input, in powers of two between these bits; tasks' sketches
#: are added up in pieces, so many at a time. It only sets the order of shingles and costs: any sketch gives the same links.
SKETCH_BYTES, SKETCH_BITS, SKETCH_PIECES, FAN_IN = 128, (16, 24), 16, 32
#: Bytes of the input that fill the largest sketch. All texts are counted whatever the input; beyond this size a task's sketch, of which
#: few places are still empty, is packed harder, so that tasks' sketches stay a small share of the input on disk.
COUNTED_BYTES = 4 * SKETCH_BYTES << SKETCH_BITS[1]
#: Steps of a count's logarithm in the sketch as it is sent: a byte for each bucket.
LOG_STEPS = 6
#: Bits of a class's number; less than 64 in tests only.
CLASS_BITS = 64
#: Most shared tokens that a prefix may be lengthened to need.
MOST_SHARED = 8
#: Cost of a candidate's verification, in entries of a prefix: two sets travel, so it grows with their size.
VERIFY_SHARE = 0.125
#: Other documents that share a token by chance, at least: what the sketch can't tell from its own noise.
CHANCE = 0.1
#: Documents by the sketch from which a token counts as hot: it is shared for certain, and its entries are dealt
#: over groups of about so many.
HOT, MOST_DEALS = 2000, (1 << 15) - 1
#: Bytes of text taken together: less than elsewhere, as the sketch is in memory too.
TEXT_BYTES = 400_000
#: Buckets of a set's profile, and the count that a bucket stops at.
BUCKETS, BUCKET_TOP = 128, 15
#: Ranges of sizes between a set's size and the largest size of a set similar to it, by which a token's list is joined.
RANGES = 6
#: Classes outside their leader's component up to which a token's list is joined as it is: so many times its length at most.
WHOLE_LIST = 64
#: Partners of a leader that are verified in one task.
PARTNERS = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, in order of row and hash. Fewer words than `words`: all as one."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each = mixed(span_hash(running_hash(data), starts, ends))
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    taken = np.minimum(count, words)[rows]  # words of a shingle of this row
    begins = np.flatnonzero(np.arange(len(rows)) - first[rows] + taken <= count[rows])
    h, n = np.zeros(len(begins), np.uint64), taken[begins]
    for k in range(words):
        here = n > k
        at = begins[here] + k
        h[here] = mixed(h[here] * np.uint64(0x100000001B3) + each[at] + np.uint64(k + 1))
    rows = rows[begins]
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[new], h[new]


def signatures(rows: np.ndarray, h: np.ndarray, n_rows: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two numbers; equal sets have equal ones. The second tells sets apart that share the first."""
    size = np.bincount(rows, minlength=n_rows)
    at = np.flatnonzero(size)
    out, spare = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    if len(at):
        first = (np.cumsum(size) - size)[at]
        one = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        two = np.add.reduceat(mixed(h + np.uint64(0x1234567)), first)
        out[at] = mixed(mixed(one) + mixed(two ^ np.uint64(0x55)) + size[at].astype(np.uint64)) >> np.uint64(64 - bits)
        spare[at] = mixed(mixed(two) + np.uint64(3) * mixed(one + np.uint64(0x77)))
    return size, out.view(np.int64), spare.view(np.int64)


def classes_of(rows: np.ndarray, h: np.ndarray, n_rows: int, bits: int, collided: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and class of each row's set: the first number, or the second where the first is one that sets collide in."""
    size, of, spare = signatures(rows, h, n_rows, bits)
    return size, np.where(np.isin(of, collided), spare, of) if len(collided) else of


def profiles(rows: np.ndarray, h: np.ndarray, n_rows: int) -> pa.Array:
    """How many of each row's shingles fall into each bucket, up to BUCKET_TOP."""
    counts = np.bincount(rows * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n_rows * BUCKETS)
    return pa.ListArray.from_arrays(np.arange(n_rows + 1, dtype=np.int32) * BUCKETS, np.minimum(counts, BUCKET_TOP).astype(np.int8))


def _read(batch, column: int):
    data, offsets, _ = string_bytes(batch.column(column))
    for low, high in row_blocks(offsets, TEXT_BYTES):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def sketch_bits(docs: DataFrame) -> tuple[int, int]:
    """Bits of the sketch, and how many times over the input fills the largest one, by the size that the plan knows of its input; a middle
    number and once where it knows none. Neither leaves out a text."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    low, high = SKETCH_BITS
    if size >= 1 << 60:
        return (low + high) // 2, 1
    return min(high, max(low, (size // SKETCH_BYTES).bit_length())), max(1, size // COUNTED_BYTES)


def _packed(counts: np.ndarray, level: int) -> bytes:
    """Counts in the least width that holds the largest, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), level)


def _counts(payload: bytes, n: int) -> np.ndarray:
    """The n counts that _packed() took; their width follows from the length."""
    held = zlib.decompress(payload)
    return np.frombuffer(held, f"u{len(held) // n}").astype(np.int64)


def survey(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, key, n, class, spare, profile) of every row as a written table, the sketch of counts of their
    shingles, and the classes that different sets collide in (by chance some at 10^11 sets), whose rows go by `spare`."""
    (bits, fills), class_bits = sketch_bits(docs), CLASS_BITS
    level = 1 if fills == 1 else 6
    size = 1 << bits
    piece = size // SKETCH_PIECES
    names = ["doc_id", "key", "n", "class", "spare", "profile", "piece", "salt", "counts"]
    small = pa.list_(pa.int8())

    def look(batches):
        counts, seen = np.zeros(size, np.uint32), 0
        for batch in batches:
            for low, high, data, offsets in _read(batch, 2):
                rows, h = shingle_sets(data, offsets, words)
                n, of, spare = signatures(rows, h, high - low, class_bits)
                k = high - low
                profile = profiles(rows, h, k)
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                seen += len(h)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, k), batch.column(1).slice(low, k), pa.array(n, pa.int64()), pa.array(of), pa.array(spare), profile, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if seen:
            salt, none = TaskContext.get().partitionId(), pa.nulls(SKETCH_PIECES, pa.int64())
            packed = [_packed(counts[i * piece : (i + 1) * piece], level) for i in range(SKETCH_PIECES)]
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(SKETCH_PIECES, small), pa.array(range(SKETCH_PIECES), pa.int32()), pa.array([salt] * SKETCH_PIECES, pa.int32()), pa.array(packed, pa.binary())], names=names)

    def add(batches):
        """Sums of the runs of equal (piece, salt); rows come in their order."""
        key, held = None, None
        for batch in batches:
            for k, s, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                now = _counts(payload, piece)
                if key == (k, s):
                    held = held + now
                    continue
                if key:
                    yield _piece(key, held)
                key, held = (k, s), now
        if key:
            yield _piece(key, held)

    def _piece(key, held):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([_packed(held, level)], pa.binary())], names=names[6:])

    both = written(docs.mapInArrow(tidy(look), "doc_id long, key long, n long, class long, spare long, profile array<tinyint>, piece int, salt int, counts binary"), "survey")
    added = both.filter("piece IS NOT NULL").select("piece", "salt", "counts")
    most = both.agg(F.max("salt")).first()[0] or 0
    while most:  # as a tree
        most //= FAN_IN
        added = added.withColumn("salt", F.expr(f"salt div {FAN_IN}").cast("int")).repartition("piece", "salt").sortWithinPartitions("piece", "salt").mapInArrow(tidy(add), "piece int, salt int, counts binary")
    sketch = np.zeros(size, np.int64)
    for r in added.toLocalIterator():  # of fixed size: a count for each bucket
        sketch[r[0] * piece : (r[0] + 1) * piece] += _counts(r[2], piece)
    rows = both.filter("piece IS NULL").drop("piece", "salt", "counts")
    collided = rows.filter("n > 0").groupBy("class").agg(F.min("spare").alias("a"), F.max("spare").alias("b")).filter("a <> b").select("class")
    return rows, sketch, np.array(sorted(r[0] for r in collided.collect()), np.int64)


def needed(n, percent: int):
    """Least overlap that a set of n has with any set of the least similarity."""
    return (percent * n + 99) // 100


def needed_column(n: Column, percent: int) -> Column:
    return F.floor((percent * n + 99) / 100).cast("long")


def prefix_entries(texts: DataFrame, sketch: np.ndarray, collided: np.ndarray, words: int, percent: int, copies: bool = False) -> DataFrame:
    """token, class, n, place, need, typical, deals: the entries of adaptive prefixes whose token another set's has too.

    place: of the token in the set's order; need: the number of shared tokens that the document chose;
    typical: how frequent its tokens are, 0 to 4095; deals: groups that a token's entries are dealt over,
    by the sketch. Entries are shuffled once, with the last three as one number. texts has one column;
    copies: whether it may have texts of one set, whose entries are then made one.
    """
    sent = texts.sparkSession.sparkContext.broadcast(np.round(LOG_STEPS * np.log2(1.0 + sketch)).astype(np.uint8))
    noise, bits, class_bits = float(sketch.mean()), int(len(sketch)).bit_length() - 1, CLASS_BITS
    names = ["token", "class", "n", "place", "tail"]

    def cut(batches):
        counts, sizes = sent.value, 2 ** (np.arange(256) / LOG_STEPS) - 1
        done: set[int] = set()
        for batch in batches:
            for low, high, data, offsets in _read(batch, 0):
                rows, h = shingle_sets(data, offsets, words)
                if not len(h):
                    continue
                size, of = classes_of(rows, h, high - low, class_bits, collided)
                fresh = np.zeros(high - low, bool)
                for i, c in enumerate(of.tolist()):  # copies in this task need no entries again
                    if size[i] and c not in done:
                        fresh[i] = True
                        done.add(c)
                if len(done) > 100_000:
                    done.clear()
                mine = fresh[rows]
                rows, h = rows[mine], h[mine]
                if not len(h):
                    continue
                seen = counts[(h >> np.uint64(64 - bits)).astype(np.int64)]
                key = (seen.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                order = np.lexsort((key, rows))
                rows, h = rows[order], h[order]
                others = sizes[seen[order]] - noise - 1
                df = 1 + np.maximum(CHANCE, others)
                size = np.where(fresh, size, 0)
                first = np.cumsum(size) - size
                place = np.arange(len(rows)) - first[rows]
                upto = np.concatenate([[0], np.cumsum(df)])
                live = np.flatnonzero(size)
                n, begin = size[live], first[live]
                must = needed(n, percent)
                best, need = np.full(len(live), np.inf), np.ones(len(live), np.int64)
                for k in range(1, MOST_SHARED + 1):
                    length = np.minimum(n - must + k, n)
                    entries = upto[begin + length] - upto[begin]
                    cost = length + VERIFY_SHARE * n * (entries - length) / k
                    better = (cost < best) & (k <= must)
                    best[better], need[better] = cost[better], k
                typical = np.minimum(4095, 128 * np.add.reduceat(np.log2(1 + df), begin) / n).astype(np.int64)
                full = np.zeros((3, high - low), np.int64)
                full[:, live] = n - must, need, typical
                spare, need, typical = full
                keep = place < (spare + need)[rows]
                r = rows[keep]
                deals = np.where(others[keep] > HOT, np.minimum(MOST_DEALS, np.ceil(others[keep] / HOT)), 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(of[r]), pa.array(size[r], pa.int64()), pa.array(place[keep], pa.int64()), pa.array((need[r] | typical[r] << 4 | deals << 16).astype(np.int32))], names=names)

    entries = texts.mapInArrow(tidy(cut), "token long, class long, n long, place long, tail int")
    deals = F.shiftright("tail", 16)
    entries = entries.withColumn("alone", F.when(deals > 0, F.col("class")))  # a hot token's entries need no count
    if copies:
        entries = entries.repartition("token", "alone").dropDuplicates(["token", "alone", "class"])
    entries = entries.withColumn("m", F.count("*").over(Window.partitionBy("token", "alone"))).filter((deals > 0) | (F.col("m") > 1))
    return entries.select("token", "class", "n", "place", F.col("tail").bitwiseAND(15).alias("need"), F.shiftright("tail", 4).bitwiseAND(4095).alias("typical"), F.greatest(deals, F.lit(1)).alias("deals"))


def _dealt(entries: DataFrame) -> DataFrame:
    """With the group of its token's that an entry is in."""
    return entries.withColumn("deal", F.pmod("class", "deals").cast("int"))


def _for_all_deals(tokens: DataFrame) -> DataFrame:
    """A row of a token for each of its groups; there are no more of these than a small share of its entries."""
    return tokens.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")


def _sizes_fit(percent: int, a: Column, b: Column) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, collided: np.ndarray, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity, as a written table.

    docs: doc_id, key (a hash of the text), text. classes: class, doc_id and key of one of its documents. a's
    partners are dealt over tasks of PARTNERS, the set of a going to each. Only the texts that pairs name are shuffled.
    """
    per = pairs.groupBy("a").agg(F.count("*").alias("m")).withColumn("deals", F.ceil(F.col("m") / PARTNERS).cast("int"))
    dealt = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"), F.col("b").alias("class"))
    heads = per.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("a").alias("class"))
    wanted = written(dealt.unionAll(heads).join(classes, "class").select(F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"), "a", "deal", "class"), "wanted")
    if few_enough(wanted, 36):
        named, sent = docs, F.broadcast(wanted)
    else:
        hashes = written(wanted.select(F.xxhash64("wanted_id", "wanted_key").alias("h")).distinct(), "wanted-hashes")
        named, sent = in_bitmap(docs, F.xxhash64("doc_id", "key"), bitmap(hashes)), wanted
    rows = named.join(sent, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("key") == F.col("wanted_key"))).select("key", "text", "a", "deal", "class")
    class_bits = CLASS_BITS
    names = ["a", "deal", "class", "head", "marks"]

    def sets(batches):
        done: set[tuple] = set()
        for batch in batches:
            a, deal, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            _, sample, back = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)  # each text once
            asked = np.argsort(back, kind="stable")
            begin = np.searchsorted(back[asked], np.arange(len(sample) + 1))
            for low, high, data, offsets in _read(pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(sample))], names=["text"]), 0):
                rows, h = shingle_sets(data, offsets, words)
                _, own = classes_of(rows, h, high - low, class_bits, collided)
                ends = np.searchsorted(rows, np.arange(high - low + 1))
                at = [i for k in range(high - low) for i in asked[begin[low + k] : begin[low + k + 1]].tolist() if of[i] == own[k]]
                fresh = [(x, y, z) not in done for x, y, z in zip(a[at].tolist(), deal[at].tolist(), of[at].tolist(), strict=True)]
                at = [i for i, new in zip(at, fresh, strict=True) if new]  # rows that repeat doc_id and text
                done.update(zip(a[at].tolist(), deal[at].tolist(), of[at].tolist(), strict=True))
                if len(done) > 1_000_000:
                    done.clear()
                marks = [h[ends[back[i] - low] : ends[back[i] - low + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(deal[at], pa.int32()), pa.array(of[at]), pa.array(a[at] == of[at]), pa.array(marks, pa.binary())], names=names)

    def compare(batches):
        current, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, deal, of, is_head, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                here = np.frombuffer(marks.as_buffer(), np.uint64)
                if is_head:
                    current, head = (a, deal), here.copy()
                elif current == (a, deal):
                    at = np.minimum(np.searchsorted(head, here), len(head) - 1)
                    shared = int((head[at] == here).sum())
                    if 100 * shared >= percent * (len(head) + len(here) - shared):
                        out.append((a, of))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    made = rows.mapInArrow(tidy(sets), "a long, deal int, class long, head boolean, marks binary")
    placed = made.repartition("a", "deal").sortWithinPartitions("a", "deal", F.desc("head"))
    return written(placed.mapInArrow(tidy(compare), "a long, b long").distinct(), "links")


def partners(entries: DataFrame, percent: int) -> DataFrame:
    """The entries with the least and the largest size (smallest, largest) of sets that their set can still link with; those without any are gone.

    What two sets that meet at a token share before it is in both prefixes, so it is among the `met` tokens up to there, and the
    overlap is at most the size without the others. Sets that only a frequent token brings together have rare ones before it, and these
    rule out partners as large as themselves.
    """
    n, most = F.col("n"), F.col("n") - (F.col("place") + 1 - F.col("met"))
    smallest = needed_column(n, percent)
    largest = F.least(F.floor(100 * n / percent), F.floor((100 + percent) * most / percent) - n).cast("long")
    return entries.withColumns({"smallest": smallest, "largest": largest}).filter("smallest <= largest")


def _range(n: Column, percent: int) -> Column:
    """Number of the range of sizes that n is in: RANGES of them between a size and the largest that is similar to it."""
    return F.floor(F.log(n.cast("double")) / (max(math.log(100 / percent), 0.01) / RANGES)).cast("int")


def _ranged(made: DataFrame, ranges: Column) -> DataFrame:
    """Entries in each of the ranges; of a token with few `outsiders` all in one."""
    few = F.col("outsiders") <= WHOLE_LIST
    return made.withColumn("range", F.explode(F.when(few, F.array(F.lit(-1))).otherwise(ranges))).drop("smallest", "largest", "outsiders")


def by_size(entries: DataFrame, percent: int) -> DataFrame:
    """Entries that can still link, each in the range of its size."""
    return _ranged(partners(entries, percent), F.array(_range(F.col("n"), percent)))


def by_sizes_wanted(entries: DataFrame, percent: int) -> DataFrame:
    """Entries that can still link, each in all ranges of sizes of its partners."""
    return _ranged(partners(entries, percent), F.sequence(_range(F.col("smallest"), percent), _range(F.col("largest"), percent)))


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share as many prefix tokens as they need.

    A pair at one token can overlap at most in the shared tokens up to it and in what follows it in either
    set; where that can't reach the similarity, the join gives no row. The pair's last shared token
    bounds it again, with the tokens that the two do share. What one set has in a bucket of its profile beyond
    the other's can't be shared either; counts that stop at a top only make that less. A token's list with many
    outside classes is joined by narrow ranges of sizes, each set with those of the sizes that partners() leaves it, so
    that sets which only a frequent token brings together don't meet at all.
    """
    a, b = (side.select("token", "range", *(F.col(c).alias(f"{name}_{c}") for c in entries.columns if c not in ("token", "outsiders"))) for name, side in (("a", by_sizes_wanted(entries.filter("outside"), percent)), ("b", by_size(entries, percent))))
    need = F.least("a_need", "b_need")
    level = lambda side: F.greatest(F.lit(1), F.col(f"{side}_place") - F.col(f"{side}_n") + needed_column(F.col(f"{side}_n"), percent) + 1)
    after = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) - 1
    reaches = lambda overlap: (100 + percent) * overlap >= percent * (F.col("a_n") + F.col("b_n"))
    beyond = F.aggregate(F.zip_with("a_profile", "b_profile", lambda x, y: F.greatest(x - y, F.lit(0).cast("tinyint"))), F.lit(0), lambda acc, x: acc + x)
    met = a.join(b, ["token", "range"]).filter((F.col("a_label") != F.col("b_label")) & (~F.col("b_outside") | (F.col("a_class") < F.col("b_class"))) & _sizes_fit(percent, F.col("a_n"), F.col("b_n")) & reaches(F.least("a_met", "b_met") + after) & (level("a") <= need) & (level("b") <= need) & reaches(F.col("a_n") - beyond))
    pairs = met.groupBy(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b")).agg(F.count("*").alias("m"), F.min(need).alias("k"), F.min(after).alias("after"), F.max(F.col("a_n") + F.col("b_n")).alias("both"))
    return pairs.filter((F.col("m") >= F.col("k")) & ((100 + percent) * (F.col("m") + F.col("after")) >= percent * F.col("both"))).select("a", "b")


def _components(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, key, text): doc_id, key, n, class of each; and of each class: its first row (doc_id, key), its rows, a
    label that classes of one component share. Both are written tables."""
    small_batches(rows.sparkSession)
    surveyed, sketch, collided = survey(rows, words)
    if len(collided):
        surveyed = surveyed.withColumn("class", F.when(F.col("class").isin(collided.tolist()), F.col("spare")).otherwise(F.col("class")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = surveyed.filter("n > 0").groupBy("class").agg(F.min(first).alias("first"), F.count("*").alias("rows"), F.any_value("profile").alias("profile"))
    classes = written(classes.select("class", "first.doc_id", "first.key", "rows", "profile"), "classes")
    surveyed = surveyed.drop("spare", "profile")
    named = classes.select("class", "doc_id", "key")
    repeated = classes.filter("rows > 1").select("class", F.col("doc_id").alias("first_id"), F.col("key").alias("first_key"))
    copies = written(surveyed.filter("n > 0").join(repeated, "class").filter("NOT (doc_id <=> first_id AND key = first_key)").select(F.col("doc_id").alias("copy_id"), F.col("key").alias("copy_key")).distinct(), "copies")
    few = few_enough(copies)
    single = rows.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("key") == F.col("copy_key")), "left_anti") if few else rows
    entries = written(prefix_entries(single.select("text"), sketch, collided, words, percent, copies=not few), "entries")
    discard(copies)

    leader = entries.groupBy("token").agg(F.max(F.struct("typical", "class", "n", "need")).alias("lead"), F.max("deals").alias("deals"))
    led = _dealt(entries).join(_for_all_deals(leader), ["token", "deal"]).filter((F.col("class") != F.col("lead.class")) & _sizes_fit(percent, F.col("n"), F.col("lead.n")))
    stars = led.groupBy(F.col("lead.class").alias("a"), F.col("class").alias("b")).agg(F.count("*").alias("m"), F.min(F.least("need", "lead.need")).alias("k")).filter("m >= k").select("a", "b")
    links = verified(rows, named, stars, collided, words, percent)
    found = labels(links)

    # of each list: what isn't in its leader's component, against all that is in another component
    lead = leader.select("token", "deals", F.col("lead.class").alias("lead"))
    at = entries.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    at = at.withColumn("met", F.row_number().over(Window.partitionBy("class").orderBy("place")))  # shared tokens up to this one
    lead = lead.join(found.select(F.col("node").alias("lead"), F.col("label").alias("lead_label")), "lead", "left").select("token", "deals", F.coalesce("lead_label", "lead").alias("lead_label"))
    at = written(_dealt(at).join(_for_all_deals(lead), ["token", "deal"]).select("token", "deals", "deal", "class", "n", "place", "met", "need", "label", (F.col("label") != F.col("lead_label")).alias("outside")), "labelled-entries")
    out = at.filter("outside").groupBy("token", "deals").agg(F.count("*").alias("outsiders"))
    opened = at.drop("deals").join(_for_all_deals(out), ["token", "deal"]).drop("deal")
    rest = written(candidates(opened.join(classes.select("class", "profile"), "class"), percent), "rest")
    more = verified(rows, named, rest, collided, words, percent)
    discard(entries, at, rest)
    every = labels(links.unionAll(more))
    names = written(classes.drop("profile").join(every.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")), "names")
    discard(classes, links, more, found, every)
    return surveyed, names


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); other columns aren't read.

    Words are runs of all but white space, A-Z in lower case; two documents link when
    100 * intersection >= percent * union of their sets of shingles. component_id is the least doc_id
    that links reach. Null, empty and wordless texts have no shingle, link with nothing and are their own
    component. Rows of one doc_id are judged each by its text. A component without a doc_id has none.
    """
    surveyed, names = _components(_keyed(docs), words, percent)
    least = names.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = written(names.join(least, "label").filter("rows > 1 OR NOT doc_id <=> component_id").select("class", "component_id"), "components")
    out = surveyed.join(F.broadcast(of) if few_enough(of) else of, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, with one document of each component that join() makes.

    The least doc_id stays (a null one only where the component has no other; of rows of that doc_id the one
    of the least hash of its text, with rows that repeat both). What is dropped is a row by its doc_id and
    text, so another text of a dropped row's doc_id stays. Rows without a shingle all stay.
    """
    rows = _keyed(docs)
    surveyed, names = _components(rows, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = names.join(names.groupBy("label").agg(first), "label").filter("rows > 1 OR NOT (doc_id <=> first.doc_id AND key = first.key)").select("class", F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key"))
    gone = surveyed.filter("n > 0").join(kept, "class").filter("NOT (doc_id <=> kept_id AND key = kept_key)")
    a, b = unused(docs, "gone_id", "gone_key")
    gone = written(gone.select(F.col("doc_id").alias(a), F.col("key").alias(b)).distinct(), "gone")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (key == F.col(b))
    if few_enough(gone):
        return docs.join(F.broadcast(gone), same, "left_anti")
    # only rows that may go are shuffled
    held, made = F.xxhash64(F.col("doc_id").cast("long"), key), bitmap(written(gone.select(F.xxhash64(a, b)), "gone-hashes"))
    return in_bitmap(docs, held, made, held=False).unionAll(in_bitmap(docs, held, made).join(gone, same, "left_anti"))
