"""Tasks for work that costs far more than moving its rows, such as edit distances of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, about.
ROWS = 2_000


def spread(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df dealt evenly over tasks of about so many rows, as many as there are cores at least.

    A file's splits say little of its tasks: a row group is one task's whatever its size, and splits without one are empty. So
    rows are counted, of files by their footers, and tasks grow in number with the input, not in size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))
