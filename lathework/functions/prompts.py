"""Prompts as columns. The wording is this library's own; types and languages are data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import TRUE_FALSE_WORDS, literal_map
from .text import strip

JUDGE_KINDS = {
    "short": "Compare the short answer with the reference. Judge facts, completeness and language.",
    "long": "Compare the detailed answer with the reference. Judge facts, coverage, reasoning and language.",
    "adversarial": "The question rests on a false premise. Judge whether the answer finds and corrects it, as the reference does.",
}


def judge_kind(question_type: Column) -> Column:
    """short or adversarial where the name says so, else long."""
    return F.when(question_type.contains("short"), "short").when(question_type.contains("adversarial"), "adversarial").otherwise("long")


def vqa_prompt(question_type: Column, question: Column, language: Column, options: list[Column]) -> Column:
    """The prompt of a question by its type; '' for an unknown type."""
    yes, no = (F.try_element_at(literal_map({k: v[i] for k, v in TRUE_FALSE_WORDS.items()}), language) for i in (0, 1))
    listed = F.concat_ws("\n", *(F.concat(F.lit(f"{letter}) "), o) for letter, o in zip("ABCD", options, strict=True)))
    return (
        F.when(question_type.isin("short_q1", "short_q2"), F.concat(strip(question), F.lit(" Keep the answer short, in "), language, F.lit(".")))
        .when(question_type == "mcq", F.concat_ws("\n", F.lit("Reply with one option alone, as <A>, <B>, <C> or <D>."), question, listed))
        .when(question_type == "true_false_q", F.concat(F.lit("Reply with one word alone, "), yes, F.lit(" or "), no, F.lit(".\n"), strip(question)))
        .when(question_type.isin("long_q", "adversarial_question"), F.concat(strip(question), F.lit(" Explain in detail, in "), language, F.lit(".")))
        .otherwise("")
    )


def translation_prompt(caption: Column, language: Column) -> Column:
    return F.concat(F.lit("Translate this caption to "), language, F.lit(", nothing else: "), caption)


def judge_prompt(question_type: Column, question: Column, reference: Column, response: Column) -> Column:
    rule = F.try_element_at(literal_map(JUDGE_KINDS), judge_kind(question_type))
    return F.concat_ws("\n", rule, F.concat(F.lit("Question: "), question), F.concat(F.lit("Reference: "), reference), F.concat(F.lit("Answer: "), response), F.lit("Reply with a number from 0 to 10 alone."))


def caption_prompt(state: Column, category: Column, given: Column) -> Column:
    return F.concat_ws(" ", F.lit("Describe the picture in some sentences."), F.concat(F.lit("Place:"), state), F.concat(F.lit("Topic:"), category), F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.lit("Known:"), given)))


def question_prompt(caption: Column, adversarial: bool = False, file: Column | None = None, category: Column | None = None) -> Column:
    """About an image of that category and caption; the file's name stands in the prompt for all question types alone."""
    asked = "Write one question with a false premise and its answer, as lines 'Adversarial Question:' and 'Answer:'." if adversarial else "Write JSON with short_questions, multiple_choice_questions with options, true_false_question and long_question."
    named = [] if file is None or adversarial else [F.concat(F.lit("File: "), file)]
    topic = [] if category is None else [F.concat(F.lit("Category: "), category)]
    return F.concat_ws("\n", F.lit(asked), *named, *topic, caption)
