"""Evaluation: predictions to scores to reports, which are in order of language and type.

A report reads its predictions once, so a model behind them is asked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import QUESTIONS
from ..functions.bleu import bleu_score
from ..functions.edit import with_ocr_scores
from ..functions.normalize import option_score, true_false_score
from ..functions.ribes import ribes_score
from ..operators import reports
from ..operators.reshape import scores_long
from ..providers import Provider, judged, stub_judge

OPEN_TYPES = ("short_q1", "short_q2", "long_q", "adversarial_question")


def score_ocr(predictions: DataFrame) -> DataFrame:
    """With anls_word and anls_char, as both texts allow."""
    return with_ocr_scores(predictions, F.col("reference_text"), F.col("predicted_text"))


def score_structured(predictions: DataFrame) -> DataFrame:
    """With mcq and true_false_q: 1.0, 0.0 or null."""
    ref, pred, lang = F.col("references"), F.col("predictions"), F.col("language")
    return predictions.withColumns({"mcq": option_score(ref["mcq_a"], pred["mcq_a"], lang), "true_false_q": true_false_score(ref["true_false_a"], pred["true_false_a"], lang)})


def _judged(predictions: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """score_open()'s rows with sample: 1 in the first of a row's questions, else 0."""
    each = F.array(*(F.struct(F.lit(q).alias("question_type"), F.col("questions")[q].alias("question"), F.col("references")[QUESTIONS[q]].alias("reference"), F.col("predictions")[QUESTIONS[q]].alias("response"), F.lit(int(i == 0)).alias("sample")) for i, q in enumerate(OPEN_TYPES)))
    long = predictions.select("id", "language", F.explode(each).alias("x")).select("id", "language", "x.*")
    return judged(long, make)


def score_open(predictions: DataFrame, make: Callable[[], Provider] = stub_judge) -> DataFrame:
    """id, language, question_type, score: a judge's score for each open question."""
    return _judged(predictions, make).select("id", "language", "question_type", "score")


def score_mmt(predictions: DataFrame) -> DataFrame:
    """With bleu and ribes; both null where a caption is missing."""
    ref, hyp = F.col("reference_caption"), F.col("predicted_caption")
    both = ref.isNotNull() & hyp.isNotNull()
    return predictions.withColumns({"bleu": bleu_score(ref, hyp), "ribes": F.when(both, ribes_score(ref, hyp))})


def ocr(predictions: DataFrame) -> DataFrame:
    return reports.in_order(reports.ocr_report(score_ocr(predictions)))


def structured(predictions: DataFrame) -> DataFrame:
    return reports.in_order(reports.typed_report(scores_long(score_structured(predictions), ["language"], ["mcq", "true_false_q"]), value="accuracy"))


def open_ended(predictions: DataFrame, make: Callable[[], Provider] = stub_judge) -> DataFrame:
    return reports.in_order(reports.typed_report(_judged(predictions, make), value="avg_score"))


def mmt(predictions: DataFrame) -> DataFrame:
    return reports.in_order(reports.mmt_report(score_mmt(predictions)))


TASKS = {"ocr": ocr, "vqa_openended": open_ended, "vqa_structured": structured, "mmt": mmt}
