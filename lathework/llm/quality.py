"""Quality: a linear-chain conditional random field over the lines of a document.

Each line has binned features of its own and of the lines before and after it;
the chain's marginals, by forward and backward sums, give each line's chance of
being good, and their mean weighted by length is the document's quality. The
field is fitted by gradient ascent with numpy on labelled documents, whose label
every line carries. Chains of a batch step together, line by line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, discard, row_blocks, running_hash, small_batches, span_hash, string_bytes, tidy, word_spans, written

#: Labelled rows that the field is fitted on, at most, and lines of one of them: a row of more lines gives as many runs of
#: RUN_LINES lines, spread over all of it, each a chain of its own.
FIT_ROWS, FIT_LINES, RUN_LINES = 4000, 400, 50
BINS, FEATURES = 6, 12
STEPS, RATE, DECAY = 120, 0.1, 1e-3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?,;:")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines that hold more than white space."""
    between = np.zeros(256, bool)
    between[0x0A] = True
    starts, ends, rows = word_spans(data, offsets, between)
    if not len(starts):
        return starts, ends, rows
    inked = np.concatenate([[0], np.cumsum(~SPACE[data])])
    kept = inked[ends] > inked[starts]
    return starts[kept], ends[kept], rows[kept]


def line_features(data: np.ndarray, offsets: np.ndarray):
    """(features of each line, rows, weights): real numbers, from the line alone but for copies of it nearby."""
    starts, ends, rows = lines_of(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES)), rows, np.zeros(0)
    size = (ends - starts).astype(float)

    def share(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends] - total[starts]

    letters = share(_LETTER[data])
    spaces = share(SPACE[data])
    marks = size - letters - spaces - share(_DIGIT[data])
    low = LOWER[data]
    run = running_hash(low)
    bounds = np.append(starts, len(data))
    w_start, w_end, _ = word_spans(low, offsets)
    w_line = np.searchsorted(bounds[:-1], w_start, "right") - 1
    words = span_hash(run, w_start, w_end)
    count = np.maximum(np.bincount(w_line, minlength=n), 1).astype(float)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (w_line[1:] == w_line[:-1])
    distinct = _distinct(words, w_line, n)
    w_size = w_end - w_start
    short = np.bincount(w_line, weights=w_size <= 3, minlength=n)
    last_mark = ~_LETTER[low[w_end - 1]] & ~_DIGIT[low[w_end - 1]] & ~_STOP[low[w_end - 1]]
    odd = np.bincount(w_line, weights=last_mark, minlength=n)
    bang = share(data == 0x21)
    same = span_hash(run, starts, ends)
    near = np.zeros(n)
    near[1:] += (same[1:] == same[:-1]) & (rows[1:] == rows[:-1])
    near[:-1] += (same[1:] == same[:-1]) & (rows[1:] == rows[:-1])
    out = np.stack([
        np.log1p(size), share(_UPPER[data]) / np.maximum(letters, 1), share(_DIGIT[data]) / size, marks / size,
        odd / count, bang / count, share(data == 0x7C) / count, np.bincount(w_line, weights=w_size, minlength=n) / count,
        np.bincount(w_line, weights=again, minlength=n) / count, distinct / count, short / count, near + _END[data[ends - 1]] * 0.5,
    ], axis=1)
    return out, rows, size


def _distinct(words: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((words, line))
    words, line = words[order], line[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    return np.bincount(line[new], minlength=n)


def grid(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines in order of their rows: the distinct rows, first line and number of lines of each."""
    names, first, count = np.unique(rows, return_index=True, return_counts=True)
    return names, first, count


@dataclass
class Field:
    edges: np.ndarray  # feature x inner edges of its bins
    weights: np.ndarray  # (own, before, after) x feature x bin
    change: np.ndarray  # 2 x 2
    start: np.ndarray  # of good at the first line

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k]) for k, e in enumerate(self.edges)], axis=1) if len(features) else np.zeros((0, len(self.edges)), np.int64)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Quality of each row; a row without lines has the first line's chance from the chain alone."""
        features, rows, size = line_features(data, offsets)
        empty = 1 / (1 + np.exp(-self.start[0]))
        out = np.full(len(offsets) - 1, empty)
        if not len(rows):
            return out
        names, first, count = grid(rows)
        unary = emission(self.weights, neighbours(self.bins(features), first, count))
        good = marginals(unary, self.change, self.start[0], first, count)[0]
        out[names] = np.add.reduceat(good * size, first) / np.add.reduceat(size, first)
        return np.clip(out, 0, 1)


def neighbours(own: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """line x (own, before, after) x feature: bins; BINS where there is no such line."""
    before, after = np.full_like(own, BINS), np.full_like(own, BINS)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = BINS
    after[first + count - 1] = BINS
    return np.stack([own, before, after], axis=1)


def emission(weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return weights[np.arange(3)[None, :, None], np.arange(bins.shape[2])[None, None, :], bins].sum((1, 2))


def marginals(unary: np.ndarray, change: np.ndarray, start: float, first: np.ndarray, count: np.ndarray):
    """Chance of good of each line, and of each pair of states of adjacent lines summed over all chains.

    Forward and backward sums, scaled at each line; chains in order of their length, so that the first
    ones of each step are those still running.
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    most = int(count[0])
    live = np.searchsorted(-count, -np.arange(1, most + 1), "right")
    z = np.clip(unary, -30, 30)
    e = np.stack([1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))], axis=1)
    m = np.exp(change)
    forward, backward = np.empty_like(e), np.ones_like(e)
    now = e[first] * np.array([1.0, np.exp(np.clip(start, -30, 30))])
    forward[first] = now = now / now.sum(1, keepdims=True)
    for t in range(1, most):
        at = first[: live[t]] + t
        now = (now[: live[t]] @ m) * e[at]
        forward[at] = now = now / now.sum(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = first[: live[t + 1]] + t
        back = (backward[at + 1] * e[at + 1]) @ m.T
        backward[at] = back / back.sum(1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    inner = np.ones(len(unary), bool)
    inner[first + count - 1] = False
    at = np.flatnonzero(inner)
    pair = forward[at][:, :, None] * m[None] * (e[at + 1] * backward[at + 1])[:, None, :]
    pair = pair / pair.sum((1, 2), keepdims=True)
    return good, pair.sum(0)


def _edges(values: np.ndarray) -> np.ndarray:
    """Inner edges of BINS bins with as many values each; where values tie, bins beyond all values take their place."""
    at = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) else np.zeros(0)
    return np.concatenate([at, np.full(BINS - 1 - len(at), np.inf)])


def runs_of(count: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of a row's lines that the field is fitted on."""
    if count <= FIT_LINES:
        return [(0, count)] if count else []
    every, taken = -(-count // RUN_LINES), FIT_LINES // RUN_LINES
    return [(k * RUN_LINES, min(count, (k + 1) * RUN_LINES)) for k in sorted({i * every // taken for i in range(taken)})]


def chains(rows: DataFrame) -> DataFrame:
    """label, lines: of rows (label, text), each run that the field is fitted on, as its lines' features in one array."""

    def made(batches):
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            label = batch.column(0).to_pylist()
            for low, high in row_blocks(offsets):
                features, of, _ = line_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for name, first, count in zip(*(x.tolist() for x in grid(of)), strict=True):
                    parts = [features[first + a : first + b].ravel() for a, b in runs_of(count)]
                    yield pa.RecordBatch.from_arrays([pa.array([label[low + name]] * len(parts), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["label", "lines"])

    return rows.mapInArrow(tidy(made), "label int, lines array<double>")


def fit(parts: list[tuple[int, np.ndarray]]) -> Field:
    """A field from chains (label, line x feature); without both kinds of label every score is a half."""
    labels = np.array([label for label, _ in parts], float)
    features = np.concatenate([x for _, x in parts]) if parts else np.zeros((0, FEATURES))
    rows = np.repeat(np.arange(len(parts)), [len(x) for _, x in parts])
    width = features.shape[1]
    edges = np.stack([_edges(features[:, k]) for k in range(width)])
    field = Field(edges, np.zeros((3, width, BINS + 1)), np.zeros((2, 2)), np.zeros(1))
    if not len(rows) or len(set(labels.tolist())) < 2:
        return field
    names, first, count = grid(rows)
    bins = neighbours(field.bins(features), first, count)
    truth = labels[rows]
    known = np.zeros((2, 2))
    for k in (0, 1):
        known[k, k] = (count - 1)[truth[first] == k].sum()
    docs = len(names)
    flat = (np.arange(3)[None, :, None] * width + np.arange(width)[None, None, :]) * (BINS + 1) + bins
    params = [field.weights, field.change, field.start]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, STEPS + 1):
        good, pairs = marginals(emission(field.weights, bins), field.change, field.start[0], first, count)
        gap = truth - good
        d_weights = np.bincount(flat.ravel(), weights=np.broadcast_to(gap[:, None, None], bins.shape).ravel(), minlength=field.weights.size).reshape(field.weights.shape)
        grads = [d_weights / docs - DECAY * field.weights, (known - pairs) / docs - 0.05 * field.change, np.array([gap[first].sum() / docs])]
        for p, g, (a, b) in zip(params, grads, moment, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return field


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Field:
    """A field from docs (doc_id, text) and labels (doc_id, quality), both without what is held out.

    Fitted on at most `most` labelled rows, half of either label where there are so many: those of the
    least hash of doc_id. Rows with a null label or doc_id are left out, and null and empty texts among the rows picked; a
    doc_id's least label counts, each of its texts is a row, and rows that repeat are one. Their lines' features are made
    on the executors. Ids are picked without reading texts; those of both labels are then read in one scan.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    have = docs.select("doc_id").join(known, "doc_id")

    def least(value: int) -> DataFrame:
        return have.filter(F.col("label") == value).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most // 2).distinct()

    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(F.broadcast(least(0).unionAll(least(1))), "doc_id").filter("length(text) > 0")
    rows = written(texts.select("label", "doc_id", F.xxhash64("text").alias("h"), "text"), "quality-sample")
    keys = rows.select("label", "doc_id", "h").distinct()
    few = keys.filter("label = 0").orderBy("doc_id", "h").limit(most // 2).unionAll(keys.filter("label = 1").orderBy("doc_id", "h").limit(most // 2))
    rows_once = rows.join(F.broadcast(few), ["label", "doc_id", "h"], "left_semi").groupBy("label", "doc_id", "h").agg(F.first("text").alias("text"))
    # at most `most` rows of at most FIT_LINES lines
    made = chains(rows_once.select("label", "text")).collect()
    discard(rows)
    return fit(sorted(((r[0], np.array(r[1], float).reshape(-1, FEATURES)) for r in made), key=lambda x: (x[0], len(x[1]), x[1].tobytes())))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score of each row: 0 to 1, higher for good. Null counts as empty: no line, the chain's own chance.

    Rows that repeat are rows each; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches):
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            parts = [sent.value.scores(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in row_blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(judge), "doc_id long, score double")
