"""Deterministic samples: rows in the order of an MD5 of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from .projections import quoted


def draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))


def stratified(df: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group; rows of a null group are left out.

    Spark cuts each task's groups to `most` rows before the shuffle (window group limit), so a hot group
    is a few rows a task.
    """
    order = Window.partitionBy(F.col(quoted(group))).orderBy(draw(F.col(quoted(key)), seed), F.col(quoted(key)))
    return df.filter(F.col(quoted(group)).isNotNull()).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


#: Hexadecimal digits of a draw that rows are counted by: as many counts as there are such numbers, whatever the rows.
DIGITS = 4


def _cut(draws: DataFrame, most: int, begin: int, count: int) -> tuple[str | None, int]:
    """(digits, rows left): rows whose `count` digits from `begin` are below `digits` all belong to the draw, and so many of those
    equal to it; None where all do."""
    counts = draws.groupBy(F.substring("draw", begin, count).alias("digits")).agg(F.count("*").alias("n")).collect()
    left = most
    for digits, n in sorted(tuple(r) for r in counts):
        if n > left:
            return digits, left
        left -= n
    return None, left


def drawn(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """min(most, rows) rows, those of the least draws; of rows of one key at the border any.

    Counts by a draw's first digits, then of those at the border by the next ones, and of these by the rest, say which draw is
    the last: that is a filter. At most 16 ** DIGITS counts come to the driver each time, of the rest a share of
    16 ** -(2 DIGITS) of the keys. No task sorts or gathers the drawn rows, however many; keys are read three times for it.
    """
    value = draw(F.col(quoted(key)), seed)
    draws, border, left = df.select(value.alias("draw")), "", most
    for count in (DIGITS, DIGITS, 32):
        digits, left = _cut(draws.filter(F.col("draw").startswith(border)), left, len(border) + 1, count)
        if digits is None:
            return df
        border += digits
    inside = df.filter(value < border)
    return inside.unionAll(df.filter(value == border).limit(left)) if left else inside


def long_enough(df: DataFrame, text: str, words: int = 10) -> DataFrame:
    """Rows of more than so many words; null text has none. Stands after a sample where the sample is of all rows."""
    return df.filter(F.coalesce(F.size(tokens(F.col(quoted(text)))) > words, F.lit(False)))
