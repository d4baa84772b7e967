"""The jobs as queries over whole tables, each run twice into one new folder, with SQL for the rows that are there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.plans.model_queries import _EDGE
from lathework.sources.scratch import scratch_path

from . import review_corpus, translate_corpus


def job1_translate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents translated by a stub that refuses some texts; the second run finds nothing new."""
    folder = scratch_path(spark, "translate-corpus")
    config = {"source": f"{sf_dir}/documents.parquet", "output": f"{folder}/out", "checkpoint": f"{folder}/checkpoint", "model": "stub-refusing", "attempts": 2, "wait_seconds": 0.0}
    for _ in range(2):
        translate_corpus.run(spark, config)
    rows = spark.read.parquet(f"{folder}/out/rows")
    return rows.select(F.col("key").alias("doc_id"), F.col("group").alias("lang"), "text", "status", "error")


def job2_review_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their labels as reviews; the second run writes nothing."""
    folder = scratch_path(spark, "review-corpus")
    config = {"source": f"{sf_dir}/documents.parquet", "reviews": f"{sf_dir}/labels.parquet", "output": f"{folder}/out", "buckets": 16}
    for _ in range(2):
        review_corpus.run(spark, config)
    rows = spark.read.parquet(f"{folder}/out/published")
    return rows.select(F.col("key").alias("doc_id"), "text", "lang", "source", "quality", "toxic", "edit_status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_translate_corpus, job2_review_corpus)}

ORACLE_SQL: dict[str, str] = {
    "job1_translate_corpus": f"""
        WITH asked AS (SELECT doc_id, lang, text, text IS NULL OR regexp_replace(text, '^{_EDGE}+|{_EDGE}+$', '', 'g') = '' AS blank, md5('Translate to Hindi: ' || text) AS reply FROM documents)
        SELECT doc_id, lang, CASE WHEN blank OR reply < '4' THEN text ELSE reply END AS text, CASE WHEN blank THEN 'blank' WHEN reply < '4' THEN 'failed' ELSE 'translated' END AS status,
               CASE WHEN NOT blank AND reply < '4' THEN 'ValueError: refused' END AS error
        FROM asked""",
    "job2_review_corpus": """
        WITH reviews AS (SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels WHERE doc_id IS NOT NULL)
        SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, text, lang, source, CASE WHEN d.doc_id IS NULL THEN r.quality ELSE coalesce(r.quality, '') END AS quality, CASE WHEN d.doc_id IS NULL THEN r.toxic ELSE coalesce(r.toxic, '') END AS toxic,
               CASE WHEN coalesce(r.quality, '') <> '' OR coalesce(r.toxic, '') <> '' THEN 'done' ELSE 'Not done yet' END AS edit_status
        FROM documents d FULL OUTER JOIN reviews r ON d.doc_id = r.doc_id""",
}
