"""Translates a growing corpus: each run takes the files that came since the last one.

    python -m jobs.translate_corpus --source /data/documents.parquet --output /out --checkpoint /out-checkpoint

The source is read as a file stream with a checkpoint (availableNow), so a run takes what is new and ends. Every text is
translated by the model of that name; blank texts stay, failed ones keep their text and carry the error. Replies are
committed in parts to `output/replies`, so a run that was stopped asks no committed prompt again, and a text that many
documents share is asked once. Rows go to `output/rows/batch=/group=`; a batch that runs again replaces its own
partitions. `output/report` has the counts of each batch, group and status.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.text import blank, strip
from lathework.providers import maker
from lathework.sources.stores import overwrite_partitions, table_if_there
from lathework.streaming.resume import replied

from .common import configured, main

DEFAULTS = "translate_corpus.json"
log = logging.getLogger(__name__)


def translated_rows(batch: DataFrame, config: dict) -> DataFrame:
    """key, group, text, status (translated, blank, failed) and error of a batch's rows."""
    key, text, group = (F.col(config[k]) for k in ("key", "text", "group"))
    rows = batch.select(key.cast("long").alias("key"), text.cast("string").alias("text"), group.cast("string").alias("group"))
    rows = rows.withColumn("prompt", F.when(~blank(F.col("text")), F.concat(F.lit(f"Translate to {config['language']}: "), F.col("text"))))
    told = replied(rows, maker(config["model"]), "prompt", f"{config['output']}/replies", attempts=config["attempts"], wait=config["wait_seconds"], commits=config["commits_per_batch"])
    status = F.when(F.col("prompt").isNull(), "blank").when(F.col("reply_error").isNull(), "translated").otherwise("failed")
    return told.select("key", "group", F.when(status == "translated", strip(F.col("reply"))).otherwise(F.col("text")).alias("text"), status.alias("status"), F.col("reply_error").alias("error"))


def run(spark: SparkSession, config: dict) -> dict:
    """Translates what is new; gives the batches of this run and the rows there are by status. Settings that aren't given are those of the file."""
    config = configured(DEFAULTS, config)
    rows_path, report_path = f"{config['output']}/rows", f"{config['output']}/report"
    source = config["source"].rstrip("/")
    schema = spark.read.parquet(source).schema
    # as a pattern, as the stream takes a plain path for a folder, and a source may be one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{source[:-1]}[{source[-1]}]")

    taken: dict[int, int] = {}  # rows of each batch of this run

    def put(batch: DataFrame, number: int) -> None:
        made = translated_rows(batch, config).withColumns({"batch": F.lit(number), "part": F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("none"))})
        overwrite_partitions(made, rows_path, "batch", "part")
        written = batch.sparkSession.read.schema(made.schema).parquet(rows_path).filter(F.col("batch") == number)
        report = written.groupBy("batch", "part", "status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
        overwrite_partitions(report.coalesce(1), report_path, "batch")
        counts = {r["status"]: r["n"] for r in report.groupBy("status").agg(F.sum("n").alias("n")).orderBy("status").collect()}
        taken[number] = sum(counts.values())
        log.info("batch %s: read %s rows, wrote %s to %s", number, taken[number], counts, rows_path)

    query = stream.writeStream.option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    there = table_if_there(spark, report_path)
    counts = {} if there is None else {r["status"]: r["n"] for r in there.groupBy("status").agg(F.sum("n").alias("n")).orderBy("status").collect()}
    log.info("read %s new rows of %s in %s batches; %s now holds %s", sum(taken.values()), source, len(taken), config["output"], counts)
    return {"batches": len(taken), "rows": counts}


if __name__ == "__main__":
    main(run, DEFAULTS, __doc__)
