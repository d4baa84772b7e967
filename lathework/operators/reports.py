"""Reports: grouped means of scores. Keys are languages and types, so partial sums do the work.

The overall row comes from the groups' sums, so it is there without any score too, and the scores are
computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded


def _placed(mean: Column, places: int | None) -> Column:
    return mean if places is None else rounded(mean, places)


def _both(groups: DataFrame, keys: list[str], sums: dict[str, str], places: int | None, totals: dict[str, str] | None = None) -> DataFrame:
    """scope, keys, count, a mean for each sum and the totals, by group and overall. A sum may have a count of infinite scores beside it.

    Each group counts for itself and for the overall row, in one more sum of the groups; a row of zeros stands for no groups.
    """
    totals = totals or {}
    counted = [c for c in groups.columns if c not in keys]

    def mean(s: str) -> Column:
        value = F.col(s).cast("double") / F.col("count")
        return F.when(F.col(f"inf_{s}") > 0, F.lit(float("inf"))).otherwise(value) if f"inf_{s}" in counted else value

    twice = groups.withColumn("scope", F.explode(F.array(F.lit("language"), F.lit("overall"))))
    twice = twice.select("scope", *(F.when(F.col("scope") == "language", F.col(k)).alias(k) for k in keys), *counted)
    zero = groups.sparkSession.range(1).select(F.lit("overall").alias("scope"), *(F.lit(None).cast("string").alias(k) for k in keys), *(F.lit(0).cast(groups.schema[c].dataType).alias(c) for c in counted))
    both = twice.unionAll(zero).groupBy("scope", *keys).agg(*(F.sum(c).alias(c) for c in counted)).filter("count > 0 OR scope = 'overall'")
    means = [_placed(F.when(F.col("count") > 0, mean(s)), places).alias(name) for s, name in sums.items()]
    return both.select("scope", *keys, "count", *means, *(F.col(c).alias(t) for c, t in totals.items()))


def ocr_report(scored: DataFrame, places: int | None = 3) -> DataFrame:
    """scope (overall, language), language, count, avg_anls_word, avg_anls_char; rows without a score aren't counted.

    Scores have four places, so they are added up as decimals: the sum doesn't depend on the order of rows.
    """
    # rows without a score drop out of the sums; a filter here would be pushed below and compute scores twice
    both = F.col("anls_word").isNotNull() & F.col("anls_char").isNotNull()
    infinite = lambda c: F.col(c) == float("inf")
    sums = [x for c in ("anls_word", "anls_char") for x in (F.sum(F.when(both & ~infinite(c), F.col(c)).cast("decimal(28,4)")).alias(f"sum_{c}"), F.count(F.when(both & infinite(c), 1)).alias(f"inf_sum_{c}"))]
    groups = scored.groupBy("language").agg(F.count(F.when(both, 1)).alias("count"), *sums)
    return _both(groups, ["language"], {"sum_anls_word": "avg_anls_word", "sum_anls_char": "avg_anls_char"}, places)


def typed_report(scores: DataFrame, total: int | None = None, value: str = "score", places: int | None = 3) -> DataFrame:
    """scope, language, question_type, count, value: means of long scores by language and type, and over all.

    Null scores are in no group. The overall row carries the rows of the input, scored or not: `total`, or the sum of the
    column sample (1 in one of each input row's scores), which is counted with the scores, so nothing is computed twice.
    """
    rows = F.lit(0) if total is not None else F.sum("sample")
    groups = scores.groupBy("language", "question_type").agg(F.count("score").alias("count"), F.sum("score").alias("sum_score"), rows.cast("long").alias("rows"))
    out = _both(groups, ["language", "question_type"], {"sum_score": value}, places, {"rows": "total_data_points"})
    n = F.col("total_data_points") if total is None else F.lit(total).cast("long")
    return out.select("scope", "language", "question_type", "count", value, F.when(F.col("scope") == "overall", n).alias("total_data_points"))


def mmt_report(scored: DataFrame) -> DataFrame:
    """target_language, count, avg_bleu, avg_ribes over rows that have both; not rounded."""
    both = F.col("bleu").isNotNull() & F.col("ribes").isNotNull()
    groups = scored.groupBy("target_language").agg(F.count(F.when(both, 1)).alias("count"), F.avg(F.when(both, F.col("bleu"))).alias("avg_bleu"), F.avg(F.when(both, F.col("ribes"))).alias("avg_ribes"))
    return groups.filter("count > 0")


def in_order(report: DataFrame) -> DataFrame:
    """A report's rows by language and type, the overall row first; its rows are few."""
    names = [c for c in ("language", "target_language", "question_type") if c in report.columns]
    first = [F.col("scope") != "overall"] if "scope" in report.columns else []
    return report.orderBy(*first, *names)


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("count"))
