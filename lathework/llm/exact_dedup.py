"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step only looks at rows of groups that still have two rows or more: lengths
are counted first, then pairs of length and prefix hash, and SHA-256 of whole
texts is taken for the surviving groups alone. Surviving keys are broadcast where
they are few, else as a bitmap of bounded size that lets no survivor go. Counts
are combined before each shuffle, so a group of copies of any size is a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, few_enough, in_bitmap, quoted, unused, written

#: Characters of the prefix that the second step hashes.
PREFIX = 64


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def digest() -> Column:
    """SHA-256 of the text's UTF-8, null as empty: 32 bytes."""
    return F.unhex(F.sha2(_text().cast("binary"), 256))


def _split(docs: DataFrame, keys: DataFrame, of: list[Column]):
    """A function of held: the rows of docs whose values `of` are among the keys, or those whose values aren't; no shuffle.
    Where keys are too many to broadcast some rows more count as held."""
    if few_enough(keys):
        names = unused(docs, *keys.columns)
        sent = F.broadcast(keys.toDF(*names))
        same = [value == F.col(name) for value, name in zip(of, names, strict=True)]
        return lambda held: docs.join(sent, same, "left_semi" if held else "left_anti")
    made = bitmap(written(keys.select(F.xxhash64(*keys.columns).alias("h")), "hashes"))
    return lambda held: in_bitmap(docs, F.xxhash64(*of), made, held)


def _survivors(docs: DataFrame, prefix: int):
    """A function of held: the rows of docs that share length and prefix hash with another row, or all the others."""
    size, head = F.octet_length(_text()), F.xxhash64(F.substring(_text(), 1, prefix))
    twice = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    lengths = written(twice(docs.select(size.alias("size")), "size"), "lengths")
    rows = _split(docs.select("text"), lengths, [size])(True)
    heads = written(twice(rows.select(size.alias("size"), head.alias("head")), "size", "head"), "heads")
    return _split(docs, heads, [size, head])


def duplicate_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """digest, keep_id, group_size of each group of two or more equal texts.

    Null text counts as empty. The largest doc_id is kept; a null doc_id only where a group has no
    other. Rows that repeat doc_id and text are rows of the group each. No rows give no groups.
    """
    rows = _survivors(docs.select("doc_id", "text"), prefix)(True)
    return rows.groupBy(digest().alias("digest")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")


def decisions(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Rows that repeat doc_id and text are one document, so they share its decision.
    """
    rows = docs.select("doc_id", F.sha2(_text().cast("binary"), 256).alias("text_sha256"))
    groups = written(duplicate_groups(docs, prefix), "groups")
    both = rows.join(F.broadcast(groups) if few_enough(groups, 56) else groups, F.unhex("text_sha256") == F.col("digest"), "left")
    return both.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The rows of docs, all their columns, with one row for each text: that of the largest doc_id.

    Rows that repeat doc_id and text are one document, of which one row stays; a null doc_id counts as the least.
    Only survivors' texts are hashed and shuffled, and each task sends a text once, however many copies it has.
    """
    part = _survivors(docs, prefix)
    key, row = unused(docs, "digest", "row")
    names = [quoted(c) for c in docs.columns]
    kept = part(True).groupBy(digest().alias(key)).agg(F.max_by(F.struct(*names), F.struct("doc_id")).alias(row))
    return part(False).unionAll(kept.select(*(F.col(row)[c].alias(c) for c in docs.columns)))
