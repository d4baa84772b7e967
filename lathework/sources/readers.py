"""Sources: CSV, JSON arrays, Parquet, XML dumps, pages and image files."""

from __future__ import annotations

import csv as csv_lines
import heapq
import re
import time
from collections.abc import Iterable
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, NumericType, StringType, StructField, StructType, _parse_datatype_string

from ..functions.text import title_url
from ..operators.unions import union_all


def csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None) -> DataFrame:
    """One file, a list or a whole folder as one scan; quotes doubled, newlines within quotes. Give the schema: inferring reads twice.
    The files' headers must be alike: one that differs fails the scan (see csv_by_name)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, by a scan of lines on the executors that keeps the first line of each file; a line break
    in a header isn't known. Files without a line have none. Headers and file paths are the driver's, which lists files anyway."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("header"))  # the first split's rows are in order in one task
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).collect():
        names = tuple(next(csv_lines.reader([r["header"].lstrip("\ufeff")]), ()))
        out.setdefault(names, []).extend(r["files"])
    return out


def _plain(file: str) -> str:
    """A file's path as readers take it: not percent-encoded, with pattern characters escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def csv_by_name(spark: SparkSession, path: str | list[str], schema: str | None = None, added: dict[str, Column] | None = None) -> DataFrame:
    """The rows of all files, columns by name: in any order, null where a file lacks one.

    With a schema its columns are read and others left out; without one all names of all files are, each with the type
    that fits all its files (differing numbers are double, else text). Files of one header are one scan, so there are as
    many scans as headers. Names count by case as Spark's do; of a name twice in a header the first one counts. added: columns made
    from the scan, such as the file's name.
    """
    groups = sorted(headers(spark, path).items())
    wanted = _parse_datatype_string(schema) if schema else None
    if wanted is None:
        seen: dict[str, list[DataType]] = {}
        for names, files in groups:
            rows = csv(spark, [_plain(f) for f in files]).select(*_first_of(names))
            filled = rows.agg(*(F.count(f"`{n}`").alias(n) for n in rows.columns)).first() if rows.columns else {}
            for field in rows.schema.fields:  # a column without a value fits any type
                seen.setdefault(field.name, []).extend([field.dataType] * bool(filled[field.name]))
        wanted = StructType([StructField(n, _fitting(kinds)) for n, kinds in seen.items()])
    known = {f.name: f.dataType for f in wanted.fields}
    extra = added or {}
    parts = []
    for names, files in groups:
        unique = [n if n not in names[:k] else f"{n}#{k}" for k, n in enumerate(names)]
        own = StructType([StructField(n, known.get(n, StringType())) for n in unique])
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(own).csv([_plain(f) for f in files])
        parts.append(rows.select(*(F.col(f"`{n}`") for n in unique if n in known), *(c.alias(k) for k, c in extra.items())))
    if not parts:
        return spark.createDataFrame([], wanted).withColumns({k: F.lit(None).cast("string") for k in extra})
    return _complete(union_all(parts), wanted, list(extra))


def _complete(rows: DataFrame, wanted: StructType, extra: list[str]) -> DataFrame:
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields), *extra)


def _first_of(names: tuple[str, ...]) -> list[Column]:
    """The first column of each name of a header; Spark numbers those of a name that repeats."""
    return [F.col(f"`{n if names.count(n) == 1 else f'{n}{names.index(n)}'}`").alias(n) for n in dict.fromkeys(names)]


def _fitting(kinds: list[DataType]) -> DataType:
    if kinds and all(k == kinds[0] for k in kinds):
        return kinds[0]
    return DoubleType() if kinds and all(isinstance(k, NumericType) for k in kinds) else StringType()


def csv_by_state(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """A folder of <state>.csv files, columns by name; state is the file's name."""
    return csv_by_name(spark, folder, schema, {"state": F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.csv$", 1)})


def csv_by_language(spark: SparkSession, folder: str, suffix: str = "_corrected", schema: str | None = None) -> DataFrame:
    """A family of {language}{suffix}.csv files, columns by name; language is that part of the name. Files of other names aren't read."""
    return csv_by_name(spark, f"{folder}/*{suffix}.csv", schema, {"language": F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), rf"^(.*){suffix}\.csv$", 1)})


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Files that each hold a JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def xml_titles(spark: SparkSession, path: str) -> DataFrame:
    """title of every page of an XML dump (bz2 too), titles that are missing or empty left out. The scan splits by page."""
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).schema("title string").load(path)
    return pages.filter("title IS NOT NULL AND title <> ''")


def dump_urls(spark: SparkSession, dumps: dict[str, str], codes: dict[str, str]) -> DataFrame:
    """language, url of all titles of the dumps that exist; a missing one is passed over.

    dumps: language to path; codes: language to the code in its URLs.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], "language string, url string")
    for language, path in dumps.items():
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).globStatus(at):
            out = out.unionByName(xml_titles(spark, path).select(F.lit(language).alias("language"), title_url(F.col("title"), F.lit(codes[language])).alias("url")))
    return out


def images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """path, content, state, category of every image of folder/state/category; bytes as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/", -1)
    return files.select("path", "content", F.try_element_at(parts, F.lit(-3)).alias("state"), F.try_element_at(parts, F.lit(-2)).alias("category"))


def base64_of(content: Column) -> Column:
    return F.base64(content)


#: Calls that a host gets at once, and seconds between two calls of a task to one host.
PER_HOST, PAUSE = 2, 0.0


def fetched(pages: DataFrame, fetch, url: str = "url", attempts: int = 3, per_host: int = PER_HOST, pause: float = PAUSE, wait: float = 0.0) -> DataFrame:
    """pages with html and error: `fetch(list of urls)` yields (html, error) for each; it is given one URL at a time.

    Pages are dealt by host and one of `per_host` slots of it, so a host gets at most so many calls at once, whatever the
    cluster, and a host that holds most pages still is several tasks' work. A task calls what is due first: a host again after
    `pause` seconds, a failed page after `wait` seconds more each time, and other hosts meanwhile; what fails `attempts`
    times stays with its error. A task holds a batch of pages at a time. Filters belong before this: the call is never
    cut short by when().
    """
    schema = StructType([*pages.schema.fields, StructField("html", StringType()), StructField("error", StringType())])
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))
    dealt = pages.repartition(host, F.pmod(F.xxhash64(url), F.lit(per_host)))

    def work(batches: Iterable):
        free: dict[str, float] = {}  # when a host may be called again
        for pdf in batches:
            html, error = [None] * len(pdf), [None] * len(pdf)
            urls = pdf[url].tolist()
            hosts = [urlsplit(u).netloc.lower() if isinstance(u, str) else "" for u in urls]
            queue = [(0.0, i, 1) for i in range(len(pdf))]  # due, page, attempt
            while queue:
                due, i, attempt = heapq.heappop(queue)
                ready = max(due, free.get(hosts[i], 0.0))
                now = time.monotonic()
                if ready > max(now, due) and queue and queue[0][0] <= now:  # others can go first
                    heapq.heappush(queue, (ready, i, attempt))
                    continue
                if ready > now:
                    time.sleep(ready - now)
                try:
                    ((html[i], error[i]),) = fetch([urls[i]])
                except Exception as e:  # any failure is a page's error
                    html[i], error[i] = None, f"{type(e).__name__}: {e}"
                free[hosts[i]] = time.monotonic() + pause
                if error[i] is not None and attempt < attempts:
                    heapq.heappush(queue, (time.monotonic() + wait * attempt, i, attempt + 1))
            yield pdf.assign(html=html, error=error)

    return dealt.mapInPandas(work, schema)
