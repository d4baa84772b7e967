"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from lathework.llm.shared import discard, table, written


def named_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it names no language for go.

    These are null texts, texts without a letter, and texts of LEAST_LETTERS letters or more that take over MOST_RATE
    times the phrases of their best language's own text (other scripts, strings of random letters). All learned languages
    and all scores are kept. Without any labelled text nothing can be judged, and all documents stay. Rows that repeat are judged
    alike; no rows give none.
    """
    learned = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return language_id.accepted(docs, language_id.train(learned), most_rate=language_id.MOST_RATE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays; null counts as empty. Of rows that repeat both one stays.
    No rows give none."""
    return exact_dedup.deduplicated(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: five-word shingles, similarity 0.8 or more; of each group the least doc_id stays.

    What goes is a row by its doc_id and text: another text of the same doc_id stays. Rows without a word stay, and rows
    without a doc_id go where their group has one with. No rows give none.
    """
    return jaccard_join.distinct(docs, words=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go; null and empty texts hold none, and items of
    under five words are none. Rows that repeat are judged alike; no rows give none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all documents in sequences of at most 1024 ids. A null text is the end id alone; rows that repeat
    are documents each; no document gives no piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES = [
    ("language_id", named_languages),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_documents),
    ("decontaminate", uncontaminated),
    ("pack", packed),
]

#: SQL can't express the first, third and last stage; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
