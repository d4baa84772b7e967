"""Projections: order and names of columns, defaults, nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import PUBLISHED, PUBLISHED_NAMES, QUESTIONS
from ..functions.text import path_part


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def published(corpus: DataFrame) -> DataFrame:
    """The published columns in their order, by their published names: all strings but an image that is bytes or a struct."""
    typed = {f.name for f in corpus.schema.fields if f.dataType.typeName() in ("binary", "struct")} & {"image_path"}
    return corpus.select(*((F.col(quoted(c)) if c in typed else F.col(quoted(c)).cast("string")).alias(PUBLISHED_NAMES.get(c, c)) for c in PUBLISHED))


def with_images(corpus: DataFrame, images: DataFrame) -> DataFrame:
    """corpus with image_path as a struct of the image's bytes (null where there is no such file) and its path.

    images: path, content, a row for each path; paths of any scheme meet by what follows it.
    """
    bare = lambda c: F.regexp_replace(c, "^[a-z][a-z0-9+.-]*:/*", "/")
    files = images.select(bare(F.col("path")).alias("_image_key"), F.col("content").alias("_image_bytes"))
    both = corpus.join(files, bare(F.col("image_path")) == F.col("_image_key"), "left")
    return both.withColumn("image_path", F.struct(F.col("_image_bytes").alias("bytes"), F.col("image_path").alias("path"))).drop("_image_key", "_image_bytes")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; absent ones don't matter."""
    return df.drop(*names)


def with_defaults(df: DataFrame, names: list[str], default: str = "") -> DataFrame:
    """The named columns are there: absent ones are added, nulls become the default."""
    return df.withColumns({n: F.coalesce(F.col(quoted(n)), F.lit(default)) if n in df.columns else F.lit(default) for n in names})


def with_path_parts(df: DataFrame, path: str = "image_path") -> DataFrame:
    """State/UT and topic from .../state/topic/file."""
    return df.withColumns({"State/UT": path_part(F.col(path), 3), "topic": path_part(F.col(path), 2)})


def option_line(question: Column, options: list[Column]) -> Column:
    """question: o1 | o2 | o3 | o4"""
    return F.concat(question, F.lit(": "), F.concat_ws(" | ", *options))


def nested_result(df: DataFrame, kept: list[str]) -> DataFrame:
    """One row a sample from columns q_<type>, p_<type>, r_<type>: structs questions, predictions, references."""

    def part(prefix: str, names: list[str]) -> Column:
        return F.struct(*(F.col(f"{prefix}_{t}").alias(n) for t, n in zip(QUESTIONS, names, strict=True)))

    answers = list(QUESTIONS.values())
    return df.select(*map(quoted, kept), part("q", list(QUESTIONS)).alias("questions"), part("p", answers).alias("predictions"), part("r", answers).alias("references"))
