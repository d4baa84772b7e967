"""Keeps a reviewed corpus: reviewers' fields are merged by key into a bucketed store, which is published by language.

    python -m jobs.review_corpus --source /data/documents.parquet --reviews /data/labels.parquet --output /out

`output/store` is made of the source's rows on the first run. Later runs merge new rows of the source and new or changed
reviews; of a key's reviews the last by `order` counts, blank fields leave what is there, and a review of an
unknown key is a row of its own. Only buckets that something changes in are rewritten, so a run over the same input writes
none. `output/published/part=` (a language) has the rows with their status, and `output/report` its counts; languages
whose rows are as they were keep their files, also where a run before stopped between store and publication.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators.projections import quoted
from lathework.sources.stores import merged_into, overwrite_partitions, table_if_there

from .common import configured, main

DEFAULTS = "review_corpus.json"
log = logging.getLogger(__name__)


def _text(df: DataFrame, names: list[str]) -> list:
    return [F.col(quoted(n)).cast("string").alias(n) for n in names]


def _marks(rows: DataFrame) -> set[tuple]:
    """(part, rows, sum of their hashes) of each language; these are few."""
    names = sorted(c for c in rows.columns if c != "part")
    mark = F.sum(F.xxhash64(*map(quoted, names)).cast("decimal(20,0)")).cast("string")
    return {tuple(r) for r in rows.groupBy("part").agg(F.count("*").alias("n"), mark.alias("mark")).collect()}


def run(spark: SparkSession, config: dict) -> dict:
    """Merges what is new; gives the buckets and languages written and the rows there are by status."""
    config = configured(DEFAULTS, config)
    key, kept, fields = config["key"], config["kept"], config["fields"]
    store, published, report_path = (f"{config['output']}/{x}" for x in ("store", "published", "report"))
    empty = {f: F.lit("") for f in fields}
    source = spark.read.parquet(config["source"]).select(F.col(quoted(key)).cast("long").alias("key"), *_text(spark.read.parquet(config["source"]), kept)).withColumns(empty)
    reviews = spark.read.parquet(config["reviews"])
    reviews = reviews.select(F.col(quoted(key)).cast("long").alias("key"), *_text(reviews, fields), F.col(quoted(config["order"])).cast("string").alias("_order"))

    first = table_if_there(spark, store) is None
    touched = set()
    if not first:  # new rows of the source; those that are there stay as they were read first
        known = spark.read.parquet(store).select(F.col("key").alias("known"))
        fresh = source.join(known, F.col("key") == F.col("known"), "left_anti").withColumn("_order", F.lit("0"))
        touched |= set(merged_into(store, fresh, "key", "_order"))
    touched |= set(merged_into(store, reviews, "key", "_order", config["buckets"], source if first else None))
    log.info("read %s rows of %s and %s of %s; wrote %s buckets of %s", source.count(), config["source"], reviews.count(), config["reviews"], len(touched), store)

    rows = spark.read.parquet(store).drop("buckets", "bucket")
    done = F.lit(False)
    for f in fields:
        done |= F.coalesce(F.col(quoted(f)), F.lit("")) != ""
    rows = rows.withColumns({"edit_status": F.when(done, "done").otherwise("Not done yet"), "part": F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("none"))})
    there = table_if_there(spark, published, rows.schema)
    parts = sorted(_marks(rows) - (set() if there is None else _marks(there)))
    if parts:
        overwrite_partitions(rows.filter(F.col("part").isin([p[0] for p in parts])), published, "part")
    report = spark.read.schema(rows.schema).parquet(published).groupBy("part", "edit_status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    report.coalesce(1).write.mode("overwrite").json(report_path)
    counts = {r["edit_status"]: r["n"] for r in report.groupBy("edit_status").agg(F.sum("n").alias("n")).orderBy("edit_status").collect()}
    languages = [p[0] for p in parts]
    log.info("wrote languages %s of %s; it now holds %s", languages, published, counts)
    return {"buckets": sorted(touched), "languages": languages, "rows": counts}


if __name__ == "__main__":
    main(run, DEFAULTS, __doc__)
