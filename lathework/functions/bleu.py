"""Sentence BLEU with one reference, 0 to 100, as an Arrow UDF.

Order 4, 13a tokens, exponential smoothing, no effective order: a hypothesis of under four tokens scores 0.
Clipped counts of runs of tokens take a hash table; as array expressions they cost the square of a text's
length, so the counts are made in Python, a batch of rows at a time. The definition is public; it isn't
checked against its library here.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 4
# The marks that 13a sets apart, and where full stops, commas and hyphens are.
_APART = re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])")
_PUNCTUATION = ((re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(text: str) -> list[str]:
    """Case kept; entities unescaped, ASCII marks apart, '.' and ',' apart unless between digits, '-' after a digit."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in _ENTITIES:
        text = text.replace(a, b)
    text = _APART.sub(r" \1 ", f" {text} ")
    for pattern, put in _PUNCTUATION:
        text = pattern.sub(put, text)
    return text.split()


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[k:] for k in range(n)), strict=False))


def bleu(reference: str | None, hypothesis: str | None) -> float | None:
    if reference is None or hypothesis is None:
        return None
    ref, hyp = tokens_13a(reference), tokens_13a(hypothesis)
    correct = [(_grams(hyp, n) & _grams(ref, n)).total() for n in range(1, ORDER + 1)]
    total = [max(0, len(hyp) - n + 1) for n in range(1, ORDER + 1)]
    if not any(correct) or not total[-1]:
        return 0.0
    logs, zeros = 0.0, 0
    for good, every in zip(correct, total, strict=True):
        if good:
            logs += math.log(100.0 * good / every)
        else:
            zeros += 1
            logs += math.log(100.0 / (2**zeros * every))
    penalty = math.exp(1 - len(ref) / len(hyp)) if len(hyp) < len(ref) else 1.0
    return penalty * math.exp(logs / ORDER)


@F.pandas_udf(T.DoubleType())
def bleu_score(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Null where either side is null."""
    return pd.Series([bleu(a if isinstance(a, str) else None, b if isinstance(b, str) else None) for a, b in zip(ref, hyp, strict=True)], dtype="float64")
