"""Corpus building: captions, questions, samples, union, publish; and the pages corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import page_parts
from ..functions.prompts import caption_prompt, question_prompt
from ..functions.replies import is_pair, is_questions, line_fields, qa_fields
from ..functions.text import join_path, path_part, url_language
from ..operators.lookups import in_targets, primary_language
from ..operators.projections import with_defaults, with_path_parts, without
from ..operators.sampling import long_enough, stratified
from ..operators.unions import rounds
from ..providers import Provider, answered, stub
from ..streaming.resume import replied


def _asked(rows: DataFrame, make: Callable[[], Provider], prompt: str, reply: str, attempts: int, accept: Callable[[str], bool] | None, store: str | None, retry_failed: bool = False) -> DataFrame:
    """answered() about each row's image; with a store the prompts that it has a reply for aren't asked."""
    if store is None:
        return answered(rows, make, prompt, reply, image="image_path", attempts=attempts, accept=accept)
    told = replied(rows, make, prompt, store, image="image_path", attempts=attempts, accept=accept, retry_failed=retry_failed)
    return told.withColumnsRenamed({"reply": reply, "reply_error": f"{reply}_error"})


def captioned(metadata: DataFrame, base: str, state: str, keep: Callable[[DataFrame, str], DataFrame], make: Callable[[], Provider] = stub, most_rounds: int = 5, store: str | None = None) -> DataFrame:
    """image_path, caption, source_url, status of metadata rows; failed rows are tried again in rounds.

    store: the path of a table of replies, by which a run that was stopped goes on; what failed is asked again.
    """
    rows = with_defaults(metadata, ["caption"]).withColumn("image_path", join_path(F.lit(base), F.lit(state), F.col("category"), F.col("image_filename")))
    rows = rows.withColumn("prompt", caption_prompt(F.lit(state), F.col("category"), F.col("caption"))).select("image_path", "source_url", "prompt")

    def work(left: DataFrame, _: int) -> DataFrame:
        return _asked(left, make, "prompt", "reply", 1, None, store, retry_failed=True).withColumn("status", F.when(F.col("reply_error").isNull(), "success").otherwise("failed"))

    return rounds(rows, work, keep, most_rounds).select("image_path", F.col("reply").alias("caption"), "source_url", "status")


def questioned(captions: DataFrame, standard: Callable[[], Provider] = stub, adversarial: Callable[[], Provider] = stub, attempts: int = 3, store: str | None = None) -> DataFrame:
    """captions with their question and answer fields and a status: success, Standard QA failed or Adversarial QA failed.

    Both prompts go out with the image, and name its category (its folder), the first one its file too. A reply that
    can't be used is asked for again, as a failed call is. store: the path of two tables of replies, by which a run that was
    stopped goes on.
    """
    of = lambda name: store and f"{store}/{name}"
    file, category = path_part(F.col("image_path"), 1), path_part(F.col("image_path"), 2)
    first = _asked(captions.drop("status").withColumn("_p", question_prompt(F.col("caption"), file=file, category=category)), standard, "_p", "_standard", attempts, is_questions, of("standard")).drop("_p")
    fields = qa_fields(F.col("_standard"))
    ok = F.col("_standard").isNotNull() & fields["long_q"].isNotNull()
    # the second prompt is only sent where the first reply was good
    second = _asked(first.withColumn("_p", F.when(ok, question_prompt(F.col("caption"), True, file, category))), adversarial, "_p", "_adversarial", attempts, is_pair, of("adversarial")).drop("_p")
    pair = line_fields(F.coalesce("_adversarial", F.lit("")))
    status = F.when(~ok, "Standard QA failed").when(pair["question"].isNull(), "Adversarial QA failed").otherwise("success")
    return second.withColumns({**{k: F.coalesce(v, F.lit("")) for k, v in fields.items()}, "adversarial_question": F.coalesce(pair["question"], F.lit("")), "adversarial_answer": F.coalesce(pair["answer"], F.lit("")), "status": status}).drop("_standard", "_standard_error", "_adversarial", "_adversarial_error")


def sampled(qa: DataFrame, most: int = 30, seed: int = 42) -> DataFrame:
    """At most `most` rows of each state whose primary language is a target."""
    rows = qa.withColumn("state", path_part(F.col("image_path"), 3)).withColumn("primary_language", primary_language(F.col("state")))
    return stratified(rows.filter(in_targets(F.col("primary_language"))), "state", "image_path", most, seed)


def final(by_language: DataFrame) -> DataFrame:
    """The union of all languages' rows with State/UT and topic, without working columns."""
    return without(with_path_parts(by_language), "status", "caption", "primary_language", "state")


def verified_pages(pages: DataFrame, level: int = 4) -> DataFrame:
    """page_url, text, image_url, lang of proofread pages that have an image; a page goes through Python once."""
    made = pages.withColumn("_page", page_parts(F.col("html"), level)).filter("_page.proofread AND _page.image IS NOT NULL")
    return made.select(F.col("url").alias("page_url"), F.col("_page.text").alias("text"), F.col("_page.image").alias("image_url"), url_language(F.col("url")).alias("lang"))


def page_sample(verified: DataFrame, languages: list[str], most: int = 90, words: int = 10, seed: int = 42) -> DataFrame:
    """At most `most` pages of each language, and of those the ones of more than `words` words."""
    return long_enough(stratified(verified.filter(F.col("lang").isin(languages)), "lang", "page_url", most, seed), "text", words)
