"""Toxicity: a numpy classifier from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive set, text with its labels unseen the
unlabelled one. The risk of the unlabelled set as negatives, less the class prior
times that of the positives as negatives, estimates the negatives' risk; where it
falls below zero the step goes the other way (Kiryo et al. 2017). Features are
the distinct words of a text and their first bytes, as 64-bit hashes. Features of
whole texts are made and counted on the executors; the driver gets the chosen
ones, and for each row of the samples which of these it has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, NOT_ALNUM, discard, mixed, row_blocks, running_hash, small_batches, span_hash, string_bytes, tidy, word_spans, written

#: Rows that the classifier is fitted on, at most: confirmed toxic ones and unlabelled ones, of any length.
POSITIVES, UNLABELLED = 2000, 12_000
FEATURES = 512
#: Least ratio of a feature's rates in toxic and in unlabelled text, as a share of the largest that the class
#: prior allows (1 / prior), and in itself.
GAIN_SHARE, LEAST_GAIN = 0.3, 1.5
#: Bytes of the beginnings of words that are features.
HEADS = (4, 5)
STEPS, RATE, DECAY = 300, 0.05, 1e-5


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of its first bytes; a feature may repeat."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NOT_ALNUM)
    run = running_hash(data)
    every, of = [span_hash(run, starts, ends)], [rows]
    for n in HEADS:
        long = ends - starts >= n
        every.append(mixed(span_hash(run, starts[long], starts[long] + n) + np.uint64(n)))
        of.append(rows[long])
    return np.concatenate(of), np.concatenate(every)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, columns = self._known(data, offsets)
        total = np.bincount(rows, weights=self.weights[columns], minlength=len(offsets) - 1) if len(rows) else np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))

    def _known(self, data, offsets):
        return known(self.keys, data, offsets)


def known(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, column) of the features that are among the sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, hashes = feature_hashes(data, offsets)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    pairs = np.unique(rows[hit] * len(keys) + at[hit])
    return pairs // len(keys), pairs % len(keys)


SAMPLE = "positive boolean, text_hash long, marks array<bigint>, features array<bigint>"


def _features(rows: DataFrame) -> DataFrame:
    """rows (positive, text) as SAMPLE: the text's distinct features, and the least hashes of its runs of three words."""

    def made(batches):
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            for low, high in row_blocks(offsets):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                n = high - low
                of, hashes = feature_hashes(part, at)
                order = np.lexsort((hashes, of))
                of, hashes = of[order], hashes[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
                counts = np.bincount(of[new], minlength=n)
                run = running_hash(part)
                features = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), hashes[new].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(span_hash(run, at[:-1], at[1:]).view(np.int64)), pa.array(_marks(part, at), pa.list_(pa.int64())), features], names=["positive", "text_hash", "marks", "features"])

    return rows.mapInArrow(tidy(made), SAMPLE)


def _marks(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Of each text the least hash of three words in a row, by either of two hashes; none of under three words."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NOT_ALNUM)
    words = span_hash(running_hash(data), starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        w = words[low:high]
        runs = mixed(mixed(mixed(w[:-2]) + w[1:-1]) + w[2:]) if len(w) >= 3 else w[:0]
        out.append([int(x) for x in (runs.min().view(np.int64), (~mixed(runs)).min().view(np.int64))] if len(runs) else [])
    return out


def varied(rows: list[tuple[int, list[int]]]) -> list[int]:
    """The hashes of rows (hash, marks) without copies and near copies, so that one copied text isn't taken for many:
    a row goes if one of its marks was there before."""
    kept, seen = [], set()
    for name, marks in sorted({h: m for h, m in rows}.items()):
        if not set(marks) & seen:
            kept.append(name)
            seen |= set(marks)
    return kept


def fit(sample: DataFrame, prior: float, keys: DataFrame | None = None) -> Model:
    """A model from a written table of SAMPLE, of those rows whose (positive, text_hash) are in keys, if given. prior: the share of toxic documents among unlabelled ones.

    Without positive or without unlabelled rows all scores are low.
    """
    prior = min(max(prior, 1e-3), 0.9)
    start = float(np.log(prior / (1 - prior)))
    rows: dict[bool, list] = {True: [], False: []}
    known_by = sample if keys is None else sample.join(F.broadcast(keys), ["positive", "text_hash"], "left_semi")
    for r in known_by.select("positive", "text_hash", "marks").dropDuplicates(["positive", "text_hash"]).collect():  # at most POSITIVES + UNLABELLED, three numbers each
        rows[r[0]].append((r[1], r[2]))
    kept = {k: varied(v) for k, v in rows.items()}
    n_p, n_u = len(kept[True]), len(kept[False])
    if not n_p or not n_u:
        return Model(np.zeros(0, np.uint64), np.zeros(0), start)
    chosen = sample.sparkSession.createDataFrame([(k, h) for k, v in kept.items() for h in v], "positive boolean, text_hash long")
    texts = sample.join(F.broadcast(chosen), ["positive", "text_hash"], "left_semi").dropDuplicates(["positive", "text_hash"])
    # bounds of the counts, so that a word that is rare by chance isn't taken for a sign
    p, u = F.count(F.when(F.col("positive"), 1)), F.count(F.when(~F.col("positive"), 1))
    counts = texts.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(p.alias("p"), u.alias("u"))
    low = (F.col("p") - 1.5 * F.sqrt("p")) / n_p
    high = (F.col("u") + 1.5 * F.sqrt("u") + 1) / n_u
    signs = counts.filter(low / high >= max(LEAST_GAIN, GAIN_SHARE / prior)).orderBy(F.desc("p"), "feature").limit(FEATURES)
    keys = np.sort(np.array([r["feature"] for r in signs.collect()], np.int64).view(np.uint64))
    place = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    have = F.array_intersect("features", F.array(*map(F.lit, place)).cast("array<bigint>"))
    x = {k: np.zeros((n, len(keys)), np.float32) for k, n in ((True, n_p), (False, n_u))}
    row = {k: 0 for k in x}
    for r in texts.select("positive", "text_hash", have.alias("have")).orderBy("positive", "text_hash").collect():  # at most FEATURES a row
        x[r[0]][row[r[0]], [place[f] for f in r[2]]] = 1
        row[r[0]] += 1
    weights, bias = descend(x[True], x[False], prior, start)
    return Model(keys, weights, bias)


def risk(w: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """With the logistic loss and the last column of x as ones: the risk of positives (times the prior), that of negatives as
    it is estimated from both sets, and the gradients of the two."""
    z_p, z_u = x_p @ w, x_u @ w
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of z as a negative
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    negative = loss(z_u).mean() - prior * loss(z_p).mean()
    d_negative = x_u.T @ sig(z_u) / len(x_u) - prior * (x_p.T @ sig(z_p)) / len(x_p)
    return float(prior * loss(-z_p).mean()), float(negative), -prior * (x_p.T @ sig(-z_p)) / len(x_p), d_negative


def descend(x_p: np.ndarray, x_u: np.ndarray, prior: float, start: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk, with the logistic loss."""
    w = np.zeros(x_p.shape[1] + 1, np.float32)
    w[-1] = start
    x_p, x_u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (x_p, x_u))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        _, negative, d_positive, d_negative = risk(w, x_p, x_u, prior)
        d = -d_negative if negative < 0 else d_negative + d_positive
        d = (d + DECAY * np.append(w[:-1], 0)).astype(np.float32)
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), both without what is held out.

    Fitted on at most POSITIVES rows that labels calls toxic and UNLABELLED rows of docs whose labels
    aren't looked at, each the rows of the least hash of doc_id, whole; the class prior is the share of toxic
    rows among all of labels (0.05 without labels). Null ids aren't learned from, and empty texts among the rows picked are
    left out; of a doc_id's several texts each is a row, and rows that repeat are one.

    Ids are picked without reading texts; those of both sets are then read in one scan.
    """
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    prior = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]

    def least(rows: DataFrame, most: int, positive: bool) -> DataFrame:
        return rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most).distinct().withColumn("positive", F.lit(positive))

    picked = least(ids.join(toxic, "doc_id", "left_semi"), POSITIVES, True).unionAll(least(ids, UNLABELLED, False))
    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("length(text) > 0").select("positive", "text")
    sample = written(_features(chosen), "toxicity-sample")
    # texts beyond the bounds are there only where a doc_id has several; their hashes alone are put in order
    keys = sample.select("positive", "text_hash").distinct()
    few = keys.filter("positive").orderBy("text_hash").limit(POSITIVES).unionAll(keys.filter("NOT positive").orderBy("text_hash").limit(UNLABELLED))
    model = fit(sample, 0.05 if prior is None else prior, few)
    discard(sample)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row: 0 to 1, higher for toxic. Null counts as empty, which scores by the bias alone.

    Rows that repeat are rows each; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            parts = [sent.value.scores(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in row_blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(judge), "doc_id long, score double")
