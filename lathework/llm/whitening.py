"""Embedding whitening: mean and covariance of distinct vectors in two passes, and projection on its eigenvectors.

Vectors are integers x = floor(64 c) + 1000000. The first pass adds up integers, so the mean is exact whatever the
order of rows; the second centres by it and adds up outer products, a matrix product for each batch. Each task
gives one partial sum, and treeAggregate merges these. LAPACK's symmetric solver gives the components on the driver,
whose data is the covariance alone (dimensions squared), and every vector is projected where it is by a broadcast
of a few columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, small_batches, tidy, written
from .vectors import finite, flat

SCALE, SHIFT = 64, 1_000_000
#: Components that are given, at most.
COMPONENTS = 16
#: Largest magnitude of 64 c for which x and sums of it are exact here.
LARGEST = float(1 << 52)
#: An eigenvalue of less than this share of the largest, for each dimension, is none: its component can't be scaled.
RANK_SHARE = 1e-13
#: Bits of the lower part of an entry: parts are added up apart, so that no sum of a task overflows.
LOW_BITS = 26
#: Partial sums from which they are merged in three levels.
MANY = 2000


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that count, as a written table.

    Rows with a null or empty vector, with null or non-finite entries or with ones too large for an exact integer
    (beyond 2^46) go; of several vector lengths the most frequent one counts (of equally frequent ones the longest).
    """
    c = F.transform("embedding", lambda e: F.lit(float(SCALE)) * e.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(finite("embedding"))
    rows = rows.select("vec_id", c.alias("c")).filter(F.forall("c", lambda e: F.abs(e) < LARGEST))
    rows = written(rows.select("vec_id", F.transform("c", lambda e: F.floor(e) + F.lit(SHIFT).cast("bigint")).alias("x")), "whitening-rows")
    sizes = [(r["n"], r["d"]) for r in rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()]  # lengths are few
    if len(sizes) > 1:
        found = rows.filter(F.size("x") == max(sizes)[1])
        found.__dict__.update(_written_to=rows.__dict__.get("_written_to"))
        return found
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    values, _ = flat(column)
    return values.reshape(len(column), -1).astype(np.int64, copy=False)


def _merged(partials: DataFrame, shapes: list[tuple]) -> list[np.ndarray] | None:
    """Sums of the partial sums (binary columns of doubles or integers of these shapes); None without any."""
    def add(a, b):
        if a is None or b is None:
            return b if a is None else a
        return [x + y for x, y in zip(a, b, strict=True)]

    def read(row):
        return [np.frombuffer(v, kind).reshape(shape).astype(object if kind == "<i8" else kind) for v, (kind, shape) in zip(row, shapes, strict=True)]

    rows = partials.rdd
    return rows.treeAggregate(None, lambda acc, row: add(acc, read(row)), add, depth=3 if rows.getNumPartitions() > MANY else 2)


@dataclass
class Moments:
    """Of the distinct vectors: how many, the sum of each dimension, and the covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    drift: np.ndarray  # mean of the centred vectors as doubles: their rounding alone

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and remainders of the sums by n, both exact."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.split()
        return (x - whole).astype(np.float64) - rest / self.n


def moments(fitted: DataFrame) -> Moments | None:
    """Of a written table of distinct x; None without rows."""
    first = fitted.select(F.size("x")).first()
    if first is None:
        return None
    d = first[0]

    def add_up(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            n, high, low = n + len(x), high + (x >> LOW_BITS).sum(axis=0), low + (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.array([n], "<i8").tobytes()], pa.binary()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], names=["n", "high", "low"])

    n, high, low = _merged(fitted.select("x").mapInArrow(tidy(add_up), "n binary, high binary, low binary"), [("<i8", (1,)), ("<i8", (d,)), ("<i8", (d,))])
    known = Moments(int(n[0]), [(int(h) << LOW_BITS) + int(w) for h, w in zip(high, low, strict=True)], np.zeros((d, d)), np.zeros(d))

    total, outer = _products(fitted, known.centred, d)
    return Moments(known.n, known.sums, outer / known.n, total / known.n)


def _products(fitted: DataFrame, centred, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the centred rows and of their outer products."""

    def multiply(batches):
        total, outer, any_row = np.zeros(d), np.zeros((d, d)), False
        for batch in batches:
            if batch.num_rows:
                c, any_row = centred(_matrix(batch.column(0))), True
                total += c.sum(axis=0)
                outer += c.T @ c
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([outer.tobytes()], pa.binary())], names=["total", "outer"])

    return tuple(_merged(fitted.select("x").mapInArrow(tidy(multiply), "total binary, outer binary"), [("<f8", (d,)), ("<f8", (d, d))]))


@dataclass
class Whitener:
    """What a vector is projected with: unit components as columns, one over the root of each eigenvalue (NaN: no scale)."""

    known: Moments
    components: np.ndarray
    scale: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.known.centred(x) @ self.components) * self.scale

    def deviations(self, x: np.ndarray) -> list:
        """Sum over dimensions of (n x - S)^2 of each row, exact: n^2 y.y - 2 n y.r + r.r with y = x - S // n, r = S % n."""
        n, (whole, rest) = self.known.n, self.known.split()
        y = x - whole
        most = int(np.abs(y).max(initial=0)) + 1
        if most * most * len(whole) >= 1 << 62 or most * n * len(whole) >= 1 << 62:
            y = y.astype(object)
        square, cross, last = (y * y).sum(axis=1), (y * rest).sum(axis=1), sum(int(r) ** 2 for r in rest)
        return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(square, cross, strict=True)]


def fit(fitted: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """A whitener from a written table of distinct x; None without rows."""
    known = moments(fitted)
    if known is None:
        return None
    values, vectors = np.linalg.eigh(known.covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(known.covariance))
    real = values > max(float(values[0]), 0.0) * RANK_SHARE * len(known.sums)
    scale = np.full(len(values), np.nan)
    scale[real] = 1 / np.sqrt(values[real])
    made = Whitener(known, vectors, scale, [float(max(v, 0.0) / trace) if trace > 0 else None for v in values], None)
    if real.any():
        k, used = int(real.sum()), np.flatnonzero(real)
        mean = (known.drift @ vectors)[used] * scale[used]
        _, outer = _products(fitted, lambda x: made.whitened(x)[:, used] - mean, k)
        made.identity_error = float(np.abs(outer / known.n - np.eye(k)).max())
    return made


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error: a row for each vector that
    integers() keeps and each of its first components.

    Only vec_id and embedding are read; rows that repeat are rows each, and count once in the fit; a null vec_id stays null.
    A component without variance (fewer distinct vectors than dimensions) has a null whitened value, and all equal
    vectors have a null explained too. deviation is null beyond 38 digits. No vector gives no rows.
    """
    small_batches(embeddings.sparkSession, rows=4096)
    rows = integers(embeddings)
    fitted = written(rows.select("x").distinct(), "whitening-fit")
    made = fit(fitted, components)
    discard(fitted)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if made is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    sent = embeddings.sparkSession.sparkContext.broadcast(made)
    top = 10**38

    def project(batches):
        w, k = sent.value, len(sent.value.scale)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            values = w.whitened(x).reshape(-1)
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array([v if v < top else None for v in w.deviations(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.known.n)), deviation.take(pa.array(each)),
                    pa.array(values, mask=np.isnan(values)), pa.array(w.explained * len(x), pa.float64()), pa.array([w.identity_error] * len(each), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tidy(project), schema)
