"""Wide to long and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import QUESTIONS
from .projections import quoted


def questions_long(samples: DataFrame, kept: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """A row for each question type of a sample: question_type, question, reference. No shuffle."""
    pairs = names or QUESTIONS
    each = F.array(*(F.struct(F.lit(q).alias("question_type"), F.col(quoted(q)).alias("question"), F.col(quoted(a)).alias("reference")) for q, a in pairs.items()))
    return samples.select(*map(quoted, kept), F.explode(each).alias("_x")).select(*map(quoted, kept), "_x.*")


def languages_long(samples: DataFrame, kept: list[str], languages: list[str]) -> DataFrame:
    """A row for each sample and target language: target_language, reference_caption; empty cells stay."""
    return samples.unpivot([F.col(quoted(c)) for c in kept], [F.col(quoted(c)) for c in languages], "target_language", "reference_caption")


def crossed_with(samples: DataFrame, values: list[str], name: str) -> DataFrame:
    """Every row with every one of a fixed list of values, as an explode: no join."""
    return samples.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def scores_long(scored: DataFrame, kept: list[str], scores: list[str]) -> DataFrame:
    """A row for each score of a row: question_type, score (null ones too), and sample: 1 in the first of a row's, else 0, so that
    the rows can be counted in the pass that adds up the scores."""
    each = F.array(*(F.struct(F.lit(s).alias("question_type"), F.col(quoted(s)).cast("double").alias("score"), F.lit(int(i == 0)).alias("sample")) for i, s in enumerate(scores)))
    return scored.select(*map(quoted, kept), F.explode(each).alias("_x")).select(*map(quoted, kept), "_x.*")


def nested_by(report: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """outer, map of inner to value: a report's groups are few, whatever the corpus."""
    return report.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), value.alias("value"))))).alias("by"))
