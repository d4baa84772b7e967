"""Sinks: CSV, JSON, split by status, typed publish, files by language, reports, errors."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.projections import published, with_images
from ..operators.reshape import nested_by
from ..operators.unions import split_by_status
from .scratch import stored


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_text(rows: DataFrame, most: int = 100_000) -> str:
    """A small result as one pretty JSON array; refuses more rows than `most`."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write JSON lines")
    return json.dumps([r.asDict(recursive=True) for r in got], ensure_ascii=False, indent=2)


def by_status(df: DataFrame, success_path: str, failed_path: str, status: str = "status") -> None:
    """Both files of a result. df is stored in the shared folder between the two, so that a model behind it runs once, whatever
    executors are lost."""
    good, bad = split_by_status(stored(df, "by-status"), status)
    csv(good, success_path)
    csv(bad, failed_path)


def publish(corpus: DataFrame, path: str, images: DataFrame | None = None) -> None:
    """The published columns; with images (path, content) the image column holds bytes and path."""
    published(corpus if images is None else with_images(corpus, images)).write.mode("overwrite").parquet(path)


def language_paths(rows: DataFrame, folder: str, path: str = "image_path", language: str = "lang") -> DataFrame:
    """rows with image_path as folder/language/file: where a copy goes; see copied()."""
    return rows.withColumn(path, F.concat_ws("/", F.lit(folder), F.col(language), F.try_element_at(F.split(path, "/", -1), F.lit(-1))))


def copied(rows: DataFrame, source: str, target: str, copy_error: str | None = None) -> DataFrame:
    """The rows whose file, at the path in column source, was copied to the path in column target; the others drop out, or
    stay with their error in the column copy_error.

    Tasks copy each file under a name of its own beside the target and then rename it, so a target is whole or not
    there; a task that runs again, or two at once, leave one file. Rows with one target give one file of either. Paths are
    local or of a store that pyarrow's file systems reach. Store the result: a plan that reads it twice copies twice.
    """
    name = copy_error or "_copy_error"

    def work(batches):
        from pyarrow import fs

        def at(path: str):
            if path.startswith("file:") or "://" not in path:
                return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
            return fs.FileSystem.from_uri(quote(path, safe=":/"))

        def copy(a, b) -> str | None:
            if not isinstance(a, str) or not isinstance(b, str):
                return "no path"
            try:
                (come, a), (go, b) = at(a), at(b)
                part = f"{b}.{uuid.uuid4().hex}.part"
                go.create_dir(b.rsplit("/", 1)[0], recursive=True)
                try:
                    with come.open_input_stream(a) as read, go.open_output_stream(part) as write:
                        while piece := read.read(1 << 20):
                            write.write(piece)
                    go.move(part, b)
                finally:
                    if go.get_file_info(part).type != fs.FileType.NotFound:
                        go.delete_file(part)
            except Exception as e:  # any failure is the row's
                return f"{type(e).__name__}: {e}"
            return None

        for pdf in batches:
            yield pdf.assign(**{name: [copy(a, b) for a, b in zip(pdf[source].tolist(), pdf[target].tolist(), strict=True)]})

    made = rows.mapInPandas(work, StructType([*rows.schema.fields, StructField(name, StringType())]))
    return made if copy_error else made.filter(F.col(name).isNull()).drop(name)


def errors(df: DataFrame, key: str, path: str, error: str = "error") -> None:
    """Rows with an error, with the time: an appended log."""
    df.filter(F.col(error).isNotNull()).select(F.current_timestamp().alias("at"), F.col(key).cast("string").alias("key"), error).write.mode("append").json(path)


def report(rows: DataFrame, path: str) -> None:
    """A long report by language and type as one JSON document {overall, per_language: {language: {type: values}}} in a file;
    its groups are few. Written by Spark, so the path may be remote."""
    fields = [c for c in rows.columns if c not in ("scope", "language", "question_type")]
    overall = rows.filter("scope = 'overall'").agg(F.first(F.struct(*fields)).alias("overall"))
    each = nested_by(rows.filter("scope = 'language'"), "language", "question_type", F.struct(*(f for f in fields if f != "total_data_points")))
    nested = each.agg(F.map_from_entries(F.collect_list(F.struct("language", "by"))).alias("per_language"))
    overall.join(F.broadcast(nested)).select("overall", "per_language").coalesce(1).write.mode("overwrite").json(path)  # one row each


def report_json(report: DataFrame) -> dict:
    """A long report as {overall, per_language}; its rows are languages and types, which are few."""
    out: dict = {"overall": {}, "per_language": {}}
    for r in report.collect():
        row = {k: v for k, v in r.asDict().items() if v is not None and k not in ("scope", "language", "question_type")}
        if r["scope"] == "overall":
            out["overall"] = row
        elif "question_type" in r.asDict():
            out["per_language"].setdefault(r["language"], {})[r["question_type"]] = row
        else:
            out["per_language"][r["language"]] = row
    return out
