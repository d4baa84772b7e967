"""Stored tables that grow: read if there, and changes merged into those buckets alone that they touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators.lookups import last_of_each, upserted
from ..operators.projections import quoted
from .scratch import stored

#: Buckets of a store that is made here.
BUCKETS = 64


def table_if_there(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at a path; None where there is none."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """df to a partitioned Parquet table; only the partitions that df has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def bucket_of(key: str, buckets: int) -> Column:
    """By the key as text, so that a key's type doesn't matter; a null key has a bucket too."""
    return F.pmod(F.xxhash64(F.col(quoted(key)).cast("string")), F.lit(buckets)).cast("int")


def merged_into(path: str, changes: DataFrame, key: str, order: str, buckets: int = BUCKETS, start: DataFrame | None = None) -> list[int]:
    """Merges changes into the store at path, as upserted() does, and gives the numbers of the buckets that were written.

    The store is partitioned by `buckets` (how many it was made with) and `bucket` (a hash of the key). Where there is none it is
    made: of start's rows, if given, and the changes. Else the buckets are found that a change alters (a new key, or a value that
    isn't blank and differs); these alone are read whole, merged in a table of their own and replaced, so a change that was
    merged before touches nothing. Changes without a key are left out, as they would be new each time. Keys may be hot in the
    store: its rows are joined, never gathered by key.
    """
    spark = changes.sparkSession
    changes = changes.filter(F.col(quoted(key)).isNotNull())
    old = table_if_there(spark, path)
    if old is None:
        if start is None:
            fresh = last_of_each(changes, changes.columns, key, order)
        else:
            fresh = upserted(start, changes, key, order)
        fresh = stored(fresh.withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(key, buckets)}), "fresh")
        overwrite_partitions(fresh.repartition("bucket"), path, "buckets", "bucket")
        return sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # as many as buckets
    made_with = [r[0] for r in old.select("buckets").distinct().collect()]
    if len(made_with) != 1:
        raise ValueError(f"{path} isn't one store: buckets {made_with}")
    n = int(made_with[0])
    columns = [c for c in old.columns if c not in ("buckets", "bucket")]
    last = stored(last_of_each(changes, columns, key, order).withColumn("bucket", bucket_of(key, n)), "changes")
    fields = [c for c in last.columns if c not in (key, "bucket")]
    # rows of the store that a change alters, and changes without a row
    new = last.select(F.col(quoted(key)).alias("_key"), F.col("bucket").alias("_bucket"), *(F.col(quoted(f)).alias(f"_new_{f}") for f in fields))
    same = F.col("bucket").eqNullSafe(F.col("_bucket")) & (F.col(quoted(key)) == F.col("_key"))
    alters = F.lit(False)
    for f in fields:
        change = F.col(quoted(f"_new_{f}"))
        alters |= ~blank(change.cast("string")) & ~change.cast(old.schema[f].dataType).eqNullSafe(F.col(quoted(f)))
    altered = old.join(new, same).filter(alters).select("bucket")
    missing = new.join(old.select(quoted(key), "bucket"), same, "left_anti").select(F.col("_bucket").alias("bucket"))
    touched = sorted(r[0] for r in altered.unionAll(missing).distinct().collect())  # as many as buckets
    if touched:
        part = old.filter(F.col("bucket").isin(touched)).select(*map(quoted, columns))
        merged = upserted(part, last.filter(F.col("bucket").isin(touched)).drop("bucket").withColumn("_order", F.lit(0)), key, "_order")
        merged = stored(merged.withColumns({"buckets": F.lit(n), "bucket": bucket_of(key, n)}), "merged")  # as its buckets are read until here
        overwrite_partitions(merged.repartition("bucket"), path, "buckets", "bucket")
    return touched
