"""Answers in one form, and their scores. Native."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import OPTION_LETTERS, TRUE_FALSE_SYNONYMS, look_up_pair
from .text import blank, strip, strip_marks


def option_letter(value: Column, language: Column) -> Column:
    """An answer to a multiple-choice question as A to D where it names one, else as it is, stripped.

    An unknown language has no letters of its own.
    """
    whole = strip(value)
    bare = F.when(whole.rlike("(?s)^<.+>$"), strip(F.substr(whole, F.lit(2), F.length(whole) - 2))).otherwise(whole)
    bare = F.regexp_replace(strip_marks(bare), r"[\u200C\u200D\u00A0]", "")
    first = F.get(F.split(bare, r"[ .\u0964]", -1), F.lit(0))
    latin = F.upper(first)
    letter = F.coalesce(look_up_pair(OPTION_LETTERS, language, first), F.when(latin.isin("A", "B", "C", "D"), latin), whole)
    return F.when(blank(value), "").otherwise(letter)


def true_false(value: Column, language: Column) -> Column:
    """An answer without marks around it, synonyms as the usual word; brackets stay."""
    bare = strip_marks(value)
    return F.when(blank(value), "").otherwise(F.coalesce(look_up_pair(TRUE_FALSE_SYNONYMS, language, bare), bare))


def exact(ref: Column, pred: Column, ref_normal: Column, pred_normal: Column) -> Column:
    """1.0 or 0.0; null where either side is blank."""
    return F.when(~blank(ref) & ~blank(pred), F.when(F.upper(ref_normal) == F.upper(pred_normal), 1.0).otherwise(0.0))


def option_score(ref: Column, pred: Column, language: Column) -> Column:
    return exact(ref, pred, option_letter(strip(ref), language), option_letter(strip(pred), language))


def true_false_score(ref: Column, pred: Column, language: Column) -> Column:
    return exact(ref, pred, true_false(strip(ref), language), true_false(strip(pred), language))


# The zeros of the scripts whose digits count.
ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66)
_RUN = "[0-9](?:_?[0-9])*"  # digits, single underscores between them
_NUMBER = rf"[+-]?(?:{_RUN}\.?(?:{_RUN})?|\.{_RUN})(?:[eE][+-]?{_RUN})?"
_INFINITE = "[+-]?[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
_DIGITS = {zero + i: str(i) for zero in ZEROS for i in range(10)}


def is_judge_score(reply: str) -> bool:
    """Whether judge_score() gives a number for the reply; for a worker that may ask again."""
    return re.fullmatch(f"{_NUMBER}|{_INFINITE}", reply.strip().translate(_DIGITS)) is not None


def judge_score(reply: Column) -> Column:
    """A judge's reply as a number from 0 to 10; null where it is none (NaN too). Digits of other scripts count,
    single underscores between digits too; an infinity is 10, a negative one 0."""
    text = strip(reply)
    for zero in ZEROS:
        text = F.translate(text, "".join(chr(zero + i) for i in range(10)), "0123456789")
    infinity = F.when(text.startswith("-"), 0.0).otherwise(10.0)
    number = F.when(text.rlike(f"^(?:{_NUMBER})$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(text.rlike(f"^(?:{_INFINITE})$"), infinity)
    return F.when(number.isNotNull(), F.greatest(F.least(number, F.lit(10.0)), F.lit(0.0)))
