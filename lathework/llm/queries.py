"""The queries of this subpackage, by name, and their SQL where SQL can express them.

Each applies its operator to whole tables with production parameters. What happens with null, empty and very long values, ties,
rows that repeat, empty tables and further columns is stated where the operator is: secrets.scan, simple8b.write_files and
read_files, packing.pack, jaccard_join.join, url_filter.judged and derived_entries, language_id.predictions,
exact_dedup.decisions, toxicity.scored, decontaminate.contaminated, quality.scored, whitening.whiten and
projection_passes.near_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard_join, language_id, packing, projection_passes, quality, secrets, simple8b, toxicity, url_filter, whitening
from .shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def _held_out(modulus: int, value: int) -> Column:
    return F.coalesce(_remainder(modulus) == value, F.lit(False)).alias("held_out")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: fixed patterns and the Markov models' spans."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.trained(docs)))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as Simple-8b files and read back."""
    return simple8b.read_files(simple8b.write_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0, size=1024)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 3-word shingles reach a Jaccard similarity of 0.9."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list. The table has no fetch day, so page_id gives one."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched"))
    return url_filter.judged(captures, url_filter.derived_entries(pages)).withColumnRenamed("capture_id", "page_id").withColumn("fetched", F.col("fetched").cast("string"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by cross-parsing; learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_remainder(4) != 2))
    return language_id.predictions(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels are learned from where they aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.filter(_remainder(3) != 1), table(spark, sf_dir, "labels").filter(_remainder(3) != 1))
    return toxicity.scored(docs, model).select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the line chains; labels are learned from where they aren't held out."""
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs.filter(_remainder(3) != 1), table(spark, sf_dir, "labels").filter(_remainder(3) != 1))
    return quality.scored(docs, field).select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the first 16 components of their covariance; see whitening.whiten for odd rows.

    A deviation beyond a long is null.
    """
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings whose cosine reaches 0.95; see projection_passes.near_duplicates for odd rows."""
    return projection_passes.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simple8b": op2_simple8b,
    "op3_packing": op3_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE
        texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM texts),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_have FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM shared WHERE 100 * both_have >= 90 * (na + nb - both_have)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a)
        SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
    """,
    "op5_url_filter": r"""
        WITH captures AS (
            SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched,
                   regexp_replace(coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), ''), '\.+$', '') AS host
            FROM pages),
        days AS (SELECT DISTINCT host, fetched, string_split(host, '.') AS parts FROM captures WHERE host <> '' AND fetched IS NOT NULL),
        keyed AS (SELECT host, fetched, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))) AS domain FROM days),
        domains AS (SELECT DISTINCT domain, md5(domain) AS h FROM keyed WHERE len(string_split(domain, '.')) >= 3),
        listed AS (
            SELECT domain, ['adult', 'malware', 'spam', 'gambling'][CAST('0x' || h[2:2] AS INTEGER) % 4 + 1] AS category,
                   CAST(DATE '2024-01-01' + CAST('0x' || h[3:4] AS INTEGER) AS DATE) AS added, CAST('0x' || h[5:5] AS INTEGER) AS r,
                   CAST('0x' || h[6:7] AS INTEGER) AS after_days, CAST('0x' || h[8:8] AS INTEGER) AS again
            FROM domains WHERE CAST('0x' || h[1:1] AS INTEGER) < 8),
        entries AS (
            SELECT domain, category, 'add' AS action, added AS dated FROM listed
            UNION ALL SELECT domain, category, 'remove', CAST(added + after_days + 1 AS DATE) FROM listed WHERE r < 8
            UNION ALL SELECT domain, category, 'add', CAST(added + after_days + 30 AS DATE) FROM listed WHERE r < 8 AND again < 8),
        valid AS (
            SELECT domain, category, action, dated AS valid_from, lead(dated) OVER (PARTITION BY domain, category ORDER BY dated) AS valid_to FROM entries),
        verdict AS (
            SELECT host, fetched, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
            FROM keyed JOIN valid ON keyed.domain = valid.domain AND action = 'add' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
            GROUP BY host, fetched)
        SELECT page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, coalesce(categories, '') AS categories
        FROM captures c LEFT JOIN verdict v ON c.host = v.host AND c.fetched = v.fetched
    """,
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
