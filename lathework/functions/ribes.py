"""RIBES, a rank correlation of word order, as an Arrow UDF; no built-in function expresses its alignment."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA, BETA = 0.25, 0.10


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of a list of numbers in the order of what follows them, by doubling the length that is compared."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def common_lengths(text: list[int], order: list[int]) -> list[int]:
    """For each place in the order, how much it has in common with the one before."""
    n = len(text)
    at = [0] * n
    for i, p in enumerate(order):
        at[p] = i
    out, h = [0] * n, 0
    for p in range(n):
        if not at[p]:
            h = 0
            continue
        q = order[at[p] - 1]
        while p + h < n and q + h < n and text[p + h] == text[q + h]:
            h += 1
        out[at[p]] = h
        h = max(0, h - 1)
    return out


def unique_runs(ref: list[int], hyp: list[int]) -> list[tuple[int, int]]:
    """For each place of hyp: length of the shortest run from there on that is once in hyp and once in ref, and its
    place in ref; (0, 0) for none.

    In the order of all suffixes of both, the longest runs that a suffix shares with others are those with its
    neighbours; a run is in ref once where it is longer than what is shared with the second nearest of ref.
    """
    text = [*ref, max(max(ref), max(hyp)) + 1, *hyp]
    order = suffix_order(np.array(text, np.int64)).tolist()
    common = common_lengths(text, order)
    begin = len(ref) + 1
    best: list = [(0, 0, 0, 0) for _ in hyp]  # shared with the nearest of ref, its place, with the second one, with another of hyp
    for sign in (1, -1):
        first = place = second = other = 0
        for k in range(len(order)) if sign > 0 else range(len(order) - 1, -1, -1):
            p = order[k]
            edge = common[k] if sign > 0 else common[k + 1] if k + 1 < len(order) else 0
            first, second, other = min(first, edge), min(second, edge), min(other, edge)
            if p >= begin:
                a, q, b, c = best[p - begin]
                best[p - begin] = (a, q, max(b, first), max(c, other)) if a >= first else (first, place, max(a, second), max(c, other))
                other = len(text)
            elif p < len(ref):
                first, place, second = len(text), p, first
    runs = []
    for a, q, b, c in best:
        need = max(b, c) + 1
        runs.append((need, q) if need <= a else (0, 0))
    return runs


def aligned(ref: list[str], hyp: list[str]) -> list[int]:
    """Places in ref of those words of hyp that can be told apart, in hyp's order.

    A word that is unique on both sides is its place. Otherwise the run of words that ends with it, or the
    one that starts with it, grows until one is unique on both sides; left is tried first.
    """
    number: dict[str, int] = {}
    r, h = ([number.setdefault(w, len(number)) for w in side] for side in (ref, hyp))
    left, right = unique_runs(r[::-1], h[::-1])[::-1], unique_runs(r, h)
    out = []
    for (a, p), (b, q) in zip(left, right, strict=True):
        if a and (not b or a <= b):
            out.append(len(ref) - 1 - p)
        elif b:
            out.append(q)
    return out


def ribes(reference: str | None, hypothesis: str | None) -> float | None:
    """0 to 1; null for an empty reference or a null."""
    if reference is None or hypothesis is None:
        return None
    ref, hyp = reference.lower().split(), hypothesis.lower().split()
    if not ref:
        return None
    if not hyp:
        return 0.0
    penalty = min(1.0, math.exp(1.0 - len(ref) / len(hyp)))
    places = aligned(ref, hyp)
    n = len(places)
    if n == 1 and len(ref) == 1:
        order, precision = 1.0, 1.0 / len(hyp)
    elif n < 2:
        order, precision = 0.0, 0.0
    else:
        before: list[int] = []
        rising = 0
        for p in places:
            rising += bisect_left(before, p)
            insort(before, p)
        order, precision = rising / (n * (n - 1) / 2), n / len(hyp)
    return order * precision**ALPHA * penalty**BETA


@F.pandas_udf(T.DoubleType())
def ribes_score(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([ribes(a if isinstance(a, str) else None, b if isinstance(b, str) else None) for a, b in zip(ref, hyp, strict=True)], dtype="float64")
