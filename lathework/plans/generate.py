"""Predictions: samples to prompts to replies to nested results.

The model is looked up by its name among those that are registered, unless a maker is given; an unknown name is a ValueError.
Every prompt goes to it with the sample's image: the path in the column that `image` names; without such a column there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import QUESTIONS, TARGET_LANGUAGES
from ..functions.prompts import translation_prompt, vqa_prompt
from ..operators.lookups import same_text
from ..operators.projections import option_line
from ..operators.reshape import languages_long
from ..operators.sampling import drawn
from ..providers import Provider, answered, answered_each, maker, prediction_text

OPTIONS = [f"mcq_opt{i}" for i in range(1, 5)]


def _shown(samples: DataFrame, image: str) -> str | None:
    return image if image in samples.columns else None


def vqa(samples: DataFrame, model: str, make: Callable[[], Provider] | None = None, language: str | None = None, most: int | None = None, error_as_text: bool = False, image: str = "image") -> DataFrame:
    """Nested predictions of samples (id, language, the published columns), one row for each.

    An empty question isn't asked and has an empty prediction; a failed one has null, or its error as text. The
    multiple-choice question is shown with its options. A sample's questions are asked in its row, so samples may
    share an id, and nothing is grouped.
    """
    rows = samples.filter(same_text(F.col("language"), language))
    rows = rows if most is None else drawn(rows, "id", most)
    head = ["id", "language", "State/UT", "topic", "source_url"]
    options = [F.col(o) for o in OPTIONS]
    asked = lambda q: F.coalesce(F.col(q), F.lit("")) != ""
    prompts = F.array(*(F.when(asked(q), vqa_prompt(F.lit(q), F.col(q), F.col("language"), options)) for q in QUESTIONS))
    told = answered_each(rows.withColumn("_prompts", prompts), make or maker(model), "_prompts", "_replies", _shown(rows, image))
    failed = lambda k: F.concat(F.lit("[ERROR: "), F.get("_replies_errors", F.lit(k)), F.lit("]")) if error_as_text else F.lit(None).cast("string")
    said = lambda k, q: F.when(~asked(q), "").otherwise(F.when(F.get("_replies_errors", F.lit(k)).isNull(), F.get("_replies", F.lit(k))).otherwise(failed(k)))
    questions = F.struct(*((option_line(F.col(q), options) if q == "mcq" else F.col(q)).alias(q) for q in QUESTIONS))
    predictions = F.struct(*(said(k, q).alias(a) for k, (q, a) in enumerate(QUESTIONS.items())))
    references = F.struct(*(F.col(a).alias(a) for a in QUESTIONS.values()))
    return told.select(F.lit(model).alias("model"), *(F.col(f"`{h}`") for h in head), questions.alias("questions"), predictions.alias("predictions"), references.alias("references"))


def mmt(samples: DataFrame, model: str, make: Callable[[], Provider] | None = None, languages: tuple[str, ...] = TARGET_LANGUAGES, most: int | None = None, image: str = "image") -> DataFrame:
    """A translation of each English caption to each target language."""
    rows = samples if most is None else drawn(samples, "id", most)
    long = languages_long(rows, ["id", "source_url", "English", *filter(None, [_shown(rows, image)])], list(languages)).withColumn("prompt", translation_prompt(F.col("English"), F.col("target_language")))
    told = prediction_text(answered(long, make or maker(model), "prompt", image=_shown(rows, image)), out="predicted_caption")
    return told.select(F.lit(model).alias("model"), "id", "target_language", "source_url", F.col("English").alias("english_caption"), "reference_caption", "predicted_caption")


def ocr(samples: DataFrame, model: str, make: Callable[[], Provider] | None = None, most: int | None = None, image: str = "image") -> DataFrame:
    """The text of each sample's page, read from its image."""
    rows = samples if most is None else drawn(samples, "id", most)
    told = prediction_text(answered(rows.withColumn("prompt", F.lit("Write down the text of this page.")), make or maker(model), "prompt", image=_shown(rows, image)), out="predicted_text")
    return told.select(F.lit(model).alias("model"), "id", "language", "page_url", F.col("text").alias("reference_text"), "predicted_text")
