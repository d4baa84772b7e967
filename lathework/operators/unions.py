"""Unions by name, and rounds of work on what failed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged(df: DataFrame, name: str, value: str | None) -> DataFrame:
    return df.withColumn(name, F.lit(value).cast("string"))


def split_by_status(df: DataFrame, status: str = "status", success: str = "success") -> tuple[DataFrame, DataFrame]:
    """Rows that succeeded and all others, null statuses with them."""
    good = F.coalesce(F.col(status) == success, F.lit(False))
    return df.filter(good), df.filter(~good)


def rounds(rows: DataFrame, work: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame, str], DataFrame], most: int = 5, status: str = "status") -> DataFrame:
    """work on rows, then on those that failed, up to `most` times; the results of all rounds.

    work returns the rows with a status. keep stores a round's result under a name and reads it again, so that
    work is done once and lost executors cost a round at most. The last round's failures stay as such.
    """
    done, left = [], rows
    for i in range(most):
        result = keep(work(left, i), f"round-{i}")
        good, bad = split_by_status(result, status)
        done.append(good)
        if bad.isEmpty():
            return union_all(done)
        left = bad.select(*rows.columns)
    return union_all([*done, bad])
