"""Edit distances in percent of the longer side; lower is better. Native, but for long texts that are very different."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import pre_process, rounded, tokens


def _percent(distance: Column, a: Column, b: Column) -> Column:
    """Both sides empty: infinity."""
    longest = F.greatest(a, b)
    return F.when(longest == 0, F.lit(float("inf"))).otherwise(distance * 100.0 / F.when(longest == 0, F.lit(1)).otherwise(longest))


#: Distances that are tried one after the other on texts of over TIMES as many characters: a try costs the text's length times
#: itself, the whole table the square of the length.
THRESHOLDS, TIMES = (64, 256, 1024), 6
#: Groups that a pair's distinct tokens are looked up in, by hash, where there are more than FEW of these; else one.
GROUPS, FEW = 64, 512


#: Cells of a column that bit_parallel() steps at a time, as the bits of one number.
BLOCK = 8192


def _tried(ref: Column, hyp: Column, far: Column) -> Column:
    longest, out = F.greatest(F.length(ref), F.length(hyp)), far
    for t in reversed(THRESHOLDS):
        out = F.when(longest > TIMES * t, F.coalesce(F.nullif(F.levenshtein(ref, hyp, t), F.lit(-1)), out)).otherwise(F.levenshtein(ref, hyp) if t == THRESHOLDS[-1] else out)
    return out


def distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two strings by code points. Long texts beyond all thresholds take the whole table (see far_distance)."""
    return _tried(ref, hyp, F.levenshtein(ref, hyp))


def near_distance(ref: Column, hyp: Column) -> Column:
    """The distance, but null for long texts beyond all thresholds."""
    return _tried(ref, hyp, F.lit(None).cast("int"))


def bit_parallel(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences, strings or tokens, with BLOCK cells of a column of the table as one number.

    A cell's differences to its upper and left neighbours are -1, 0 or 1, so a column's are two bit vectors, and one step
    of some additions and logical operations on these makes the next column. The longer side is cut in blocks;
    of each block's last row only the differences go to the next one.
    """
    if len(a) < len(b):
        a, b = b, a
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    end_a, end_b = len(a), len(b)
    while end_b > low and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[low:end_a], b[low:end_b]
    if not len(b):
        return len(a)
    above = [1] * len(b)  # of the row above a block: each cell less its left neighbour
    for begin in range(0, len(a), BLOCK):
        part = a[begin : begin + BLOCK]
        where: dict = {}
        for i, x in enumerate(part):
            where.setdefault(x, bytearray((len(part) + 7) // 8))[i >> 3] |= 1 << (i & 7)
        equal = {x: int.from_bytes(v, "little") for x, v in where.items()}
        full, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
        up, down = full, 0  # cells that are one more, or one less, than the one above
        for j, x in enumerate(b):
            same, left = equal.get(x, 0), above[j]
            keep = same | down
            if left < 0:
                same |= 1
            zero = ((((same & up) + up) ^ up) | same) & full
            more, less = down | (full ^ (zero | up)), up & zero
            above[j] = 1 if more & last else -1 if less & last else 0
            more, less = (more << 1 | (left > 0)) & full, (less << 1 | (left < 0)) & full
            up, down = less | (full ^ (keep | more)), more & keep
    return len(a) + sum(above)


@F.pandas_udf(IntegerType())
def far_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """bit_parallel() of the rows where both sides are there."""
    return pd.Series([bit_parallel(a, b) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(ref, hyp, strict=True)], dtype="Int32")


def char_error(ref: Column, hyp: Column) -> Column:
    return _percent(distance(ref, hyp), F.length(ref), F.length(hyp))


def _group(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(GROUPS)).cast("int")


def vocabulary_of(ref: Column, hyp: Column) -> Column:
    """The distinct tokens of both, by group; in one where they are few, as each group is a pass over them."""

    def grouped(every: Column) -> Column:
        by_hash = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.filter(every, lambda t: _group(t) == g))
        return F.when(F.size(every) > FEW, by_hash).otherwise(F.array(every))

    return F.get(F.transform(F.array(F.array_distinct(F.concat(ref, hyp))), grouped), F.lit(0))


def token_codes(side: Column, vocabulary: Column) -> Column:
    """A token array as a string with one code point for each distinct token of the pair.

    The first 35,000 numbers of tokens are code points from U+4E00, further ones from U+10000; so a pair may
    have some hundred thousand distinct tokens. vocabulary: vocabulary_of(ref, hyp) as a column that is there
    already; as an expression it would be made again for each token. A token is looked up in its group alone.
    """
    by_hash = F.transform(side, lambda t: (F.array_position(F.get(vocabulary, _group(t)), t) - 1) * GROUPS + _group(t) + 1)
    places = F.when(F.size(vocabulary) == 1, F.transform(side, lambda t: F.array_position(F.get(vocabulary, F.lit(0)), t))).otherwise(by_hash)
    points = F.transform(places, lambda p: F.when(p < 35_000, p + 0x4E00).otherwise(p - 35_000 + 0x10000))
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(F.hex(p), 8, "0")), "")), "UTF-32")


def token_distance(ref: Column, hyp: Column, vocabulary: Column) -> Column:
    """Edit distance of two token arrays, as that of their token_codes()."""
    return distance(token_codes(ref, vocabulary), token_codes(hyp, vocabulary))


def with_ocr_scores(df: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """df with anls_word, anls_char of preprocessed texts, rounded to four places; distances, whatever the names say.

    Each step is a projection of its own, so that no distance is computed twice. Pairs beyond the thresholds alone, long and
    very different texts, go to far_distance() in Arrow batches; the others are null there.
    """
    out = df.withColumns({"_r": pre_process(ref), "_h": pre_process(hyp)}).withColumns({"_rt": tokens(F.col("_r")), "_ht": tokens(F.col("_h"))})
    out = out.withColumn("_v", vocabulary_of(F.col("_rt"), F.col("_ht")))
    out = out.withColumns({"_rw": token_codes(F.col("_rt"), F.col("_v")), "_hw": token_codes(F.col("_ht"), F.col("_v"))})
    out = out.withColumns({"_w": near_distance(F.col("_rw"), F.col("_hw")), "_c": near_distance(F.col("_r"), F.col("_h"))})
    far = lambda d, a, b: far_distance(*(F.when(F.col(d).isNull(), F.col(x)) for x in (a, b)))
    out = out.withColumns({"_w2": far("_w", "_rw", "_hw"), "_c2": far("_c", "_r", "_h")})
    out = out.withColumns({"_w": _percent(F.coalesce("_w", "_w2"), F.size("_rt"), F.size("_ht")), "_c": _percent(F.coalesce("_c", "_c2"), F.length("_r"), F.length("_h"))})
    return out.withColumns({"anls_word": rounded(F.col("_w"), 4), "anls_char": rounded(F.col("_c"), 4)}).drop("_r", "_h", "_rt", "_ht", "_v", "_rw", "_hw", "_w", "_c", "_w2", "_c2")
