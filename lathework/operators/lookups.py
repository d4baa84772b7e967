"""Lookups, overlays and upserts as joins.

Keys may be hot: base rows are never gathered by key. The correction side is reduced to one row a key
before it is joined, so Spark can split a hot key of the base side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import STATE_LANGUAGE, TARGET_LANGUAGES, literal_map
from ..functions.text import blank
from .projections import quoted


def primary_language(state: Column) -> Column:
    """A state's language; null for a state that isn't known. The table has 36 rows, so it is a literal."""
    return F.try_element_at(literal_map(STATE_LANGUAGE), state)


def in_targets(language: Column) -> Column:
    return language.isin(*TARGET_LANGUAGES)


def same_text(column: Column, value: str | None) -> Column:
    """Equality without regard to case; true for all where no value is given."""
    return F.lit(True) if value is None else F.lower(column) == F.lower(F.lit(value))


def retry_rows(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Rows whose key failed."""
    return rows.join(failed.select(key).distinct(), key, "left_semi")


def one_for_each(df: DataFrame, keys: list[str], order: str, first: bool) -> DataFrame:
    """The first or the last row of each key by `order`. Combined before the shuffle, so a hot key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*map(quoted, rest)), F.col(quoted(order))).alias("_row")).select(*map(quoted, keys), "_row.*")


def overlaid(base: DataFrame, corrections: DataFrame, key: str, fields: list[str], order: str, latest: bool = True, status: str | None = "edit_status") -> DataFrame:
    """base with the fields of its correction, the last of a key by `order` (the first: latest=False).

    Where a row has no correction its own fields stay; `status` says done or Not done yet.
    """
    fixes = one_for_each(corrections.select(key, order, *map(quoted, fields)), [key], order, first=not latest)
    fixes = fixes.select(F.col(quoted(key)).alias("_key"), F.struct(*map(quoted, fields)).alias("_fix"))
    both = base.join(fixes, F.col(quoted(key)) == F.col("_key"), "left")
    out = both.withColumns({f: F.coalesce(F.col("_fix")[f], F.col(quoted(f))) for f in fields})
    if status:
        out = out.withColumn(status, F.when(F.col("_key").isNotNull(), "done").otherwise("Not done yet"))
    return out.drop("_key", "_fix")


def last_of_each(changes: DataFrame, columns: list[str], key: str, order: str) -> DataFrame:
    """Of changes the last row of each key by `order`: key and those of `columns` that changes have, but `order`."""
    fields = [c for c in columns if c not in (key, order) and c in changes.columns]
    return one_for_each(changes.select(key, order, *map(quoted, fields)), [key], order, first=False).select(quoted(key), *map(quoted, fields))


def upserted(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with changes merged by key: every row of a matched key takes the change's columns, blank ones
    keep the base's value; unmatched changes are new rows. The last change of a key by `order` counts.

    A left join of base, whose hot keys Spark can split, and the changes that no row of base has.
    """
    last = last_of_each(changes, base.columns, key, order)
    new = last.withColumnsRenamed({c: f"_new_{c}" for c in last.columns})
    had = F.col(quoted(f"_new_{key}")).isNotNull()

    def field(f: str) -> Column:
        if f == key or f not in last.columns:
            return F.col(quoted(f))
        change = F.col(quoted(f"_new_{f}"))
        return F.when(had & ~blank(change.cast("string")), change).otherwise(F.col(quoted(f))).alias(f)

    merged = base.join(new, F.col(quoted(key)) == F.col(quoted(f"_new_{key}")), "left").select(*map(field, base.columns))
    added = last.join(base.select(quoted(key)).distinct(), key, "left_anti")
    lacking = {c: F.lit(None).cast(base.schema[c].dataType) for c in base.columns if c not in last.columns}
    return merged.unionByName(added.withColumns(lacking).select(*(F.col(quoted(c)).cast(base.schema[c].dataType).alias(c) for c in base.columns)))
