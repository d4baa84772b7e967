"""Resumable enrichment: replies are committed to a store in parts, so a run that stops asks no committed prompt again.

The store is a Parquet table of prompt keys and replies, to which each part is appended by Spark's committer; its keys say
what is done, whichever run did it. What a stopped part had not committed is asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..operators.projections import quoted
from ..providers import Provider, answered
from ..sources.scratch import scratch_path
from ..sources.stores import table_if_there

STORE = "prompt_key string, reply string, reply_error string"
#: Parts that a run's prompts are committed in.
COMMITS = 8


def prompt_key(prompt: str, image: str | None = None) -> Column:
    """SHA-256 of prompt and image path; null for no prompt."""
    return F.sha2(F.concat(F.col(quoted(prompt)), F.lit("\u001f"), F.coalesce(F.col(quoted(image)), F.lit("")) if image else F.lit("")), 256)


def _known(spark: SparkSession, store: str) -> DataFrame | None:
    """The replies that are there now. By its files, as Spark takes two readings of one folder for the same, of whichever time, where
    a plan holds both."""
    return table_if_there(spark, f"{store.rstrip('/')}/part-*", STORE)


def replied(rows: DataFrame, make: Callable[[], Provider], prompt: str, store: str, image: str | None = None, attempts: int = 3, wait: float = 0.0, accept: Callable[[str], bool] | None = None, commits: int = COMMITS, retry_failed: bool = False) -> DataFrame:
    """rows with reply and reply_error, as answered() gives them, each distinct prompt asked once over all runs with this store.

    Prompts that the store has aren't asked (failed ones are with retry_failed; a later success counts). The others are
    written once in `commits` parts by hash, and each part is asked and appended before the next, so a stop costs one part.
    A prompt of very many rows is asked once, and rows are joined with replies, whose keys are unique, so Spark can
    split a hot prompt.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_prompt_key", prompt_key(prompt, image))
    shown = F.col(quoted(image)) if image else F.lit(None).cast("string")
    wanted = keyed.filter("_prompt_key IS NOT NULL").groupBy(F.col("_prompt_key").alias("prompt_key")).agg(F.any_value(F.col(quoted(prompt))).alias("prompt"), F.any_value(shown).alias("image"))
    known = _known(spark, store)
    if known is not None:
        done = known.filter("reply_error IS NULL") if retry_failed else known
        wanted = wanted.join(done.select("prompt_key").distinct(), "prompt_key", "left_anti")
    path = scratch_path(spark, "wanted")
    wanted.withColumn("part", F.pmod(F.xxhash64("prompt_key"), F.lit(commits)).cast("int")).write.partitionBy("part").parquet(path)
    todo = spark.read.schema("prompt_key string, prompt string, image string, part int").parquet(path)
    for part in sorted(r[0] for r in todo.select("part").distinct().collect()):
        asked = answered(todo.filter(F.col("part") == part).drop("part"), make, "prompt", image="image", attempts=attempts, wait=wait, accept=accept)
        asked.select("prompt_key", "reply", "reply_error").write.mode("append").parquet(store)
    known = _known(spark, store)
    if known is None:
        return rows.withColumns({"reply": F.lit(None).cast("string"), "reply_error": F.lit(None).cast("string")})
    best = F.min(F.struct(F.col("reply_error").isNotNull().alias("failed"), "reply", "reply_error"))
    replies = known.groupBy(F.col("prompt_key").alias("_reply_key")).agg(best.alias("_reply"))
    out = keyed.join(replies, F.col("_prompt_key") == F.col("_reply_key"), "left")
    return out.withColumns({"reply": F.col("_reply.reply"), "reply_error": F.col("_reply.reply_error")}).drop("_prompt_key", "_reply_key", "_reply")


def translated_fields(rows: DataFrame, fields: list[str], make: Callable[[], Provider], language: str, store: str, attempts: int = 3, wait: float = 0.0, commits: int = COMMITS) -> DataFrame:
    """rows as providers.translated() gives them (fields translated, failed_fields, errors), by a store of replies: a run that
    was stopped goes on, and a text that several rows or fields have is asked once."""
    out = rows.withColumns({"failed_fields": F.array().cast("array<string>"), "errors": F.array().cast("array<string>")})
    for f in fields:
        value = F.col(quoted(f))
        asked = out.withColumn("_field_prompt", F.when(~blank(value), F.concat(F.lit(f"Translate to {language}: "), value)))
        told = replied(asked, make, "_field_prompt", store, attempts=attempts, wait=wait, commits=commits)
        error, good = F.col("reply_error"), F.col("_field_prompt").isNotNull() & F.col("reply_error").isNull()
        failed = lambda column, item: F.when(error.isNotNull(), F.array_append(column, item)).otherwise(F.col(column))
        out = told.withColumns({f: F.when(good, strip(F.col("reply"))).otherwise(value), "failed_fields": failed("failed_fields", F.lit(f)), "errors": failed("errors", F.concat(F.lit(f"{f} - "), error))}).drop("_field_prompt", "reply", "reply_error")
    return out
