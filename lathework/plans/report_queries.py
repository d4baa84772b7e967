"""Queries over reports, files by name and answers' words, with DuckDB SQL for the same rows beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import TRUE_FALSE_SYNONYMS, TRUE_FALSE_WORDS
from ..functions.images import image_format, image_size, too_large
from ..functions.normalize import true_false
from ..operators import reports, reshape, sampling, unions
from ..providers import sections, stub_refusing, stub_seeing
from ..sources import readers, writers
from ..sources.scratch import scratch_path
from ..sources.stores import merged_into
from ..streaming.resume import translated_fields
from . import corpus
from .model_queries import _table

LANGUAGES = sorted(TRUE_FALSE_WORDS)
_LANGUAGE_SQL = "[" + ", ".join(f"'{x}'" for x in LANGUAGES) + "][CAST({key} % 11 + 1 AS INTEGER)]"


def _language(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LANGUAGES)), (key % len(LANGUAGES) + 1).cast("int"))


# ---------------------------------------------------------------- reports


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of two decimals for each event, null for some."""
    value = (F.abs("value") % 100).cast("decimal(10,2)").cast("double")
    return _table(spark, sf_dir, "events").select("event_id", _language(F.col("event_id")).alias("language"), F.when(F.col("event_id") % 3 != 0, value).alias("anls_word"), F.when(F.col("event_id") % 4 != 0, value / 2).alias("anls_char"))


def ocr_report_of_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The OCR report where a third of the rows lack one score and a quarter the other: these don't count."""
    rows = _scores(spark, sf_dir).filter(F.col("event_id") % 11 != 5)  # a language without any row
    return reports.ocr_report(rows.withColumn("anls_word", F.when(F.col("language") != LANGUAGES[2], F.col("anls_word"))), places=None).withColumns({c: F.round(c, 6) for c in ("avg_anls_word", "avg_anls_char")})


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(_language(F.col("conv_id")).alias("language"), F.when(F.col("turn") % 3 != 0, F.length("text") % 2).alias("mcq"), F.when(F.col("turn") % 2 != 0, F.length("role") % 2).alias("true_false_q"))
    return reports.typed_report(reshape.scores_long(rows, ["language"], ["mcq", "true_false_q"]), value="accuracy", places=None).withColumn("accuracy", F.round("accuracy", 6))


def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's counts and means by type, as one value."""
    said = F.concat_ws("/", F.col("count").cast("string"), F.format_number("accuracy", 4))
    nested = reshape.nested_by(_typed(spark, sf_dir).filter("scope = 'language'"), "language", "question_type", said)
    return nested.select("language", F.col("by")["mcq"].alias("mcq"), F.col("by")["true_false_q"].alias("true_false_q"), F.size("by").alias("types"))


def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's rows with their place in its order, taken when they are written."""
    path = scratch_path(spark, "ordered")
    rows = reports.in_order(_typed(spark, sf_dir)).coalesce(1)
    rows.select("scope", "language", "question_type", "count", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    return spark.read.parquet(path)


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a nested JSON document in a file, read again."""
    path = scratch_path(spark, "report")
    writers.report(_typed(spark, sf_dir), path)
    whole = spark.read.schema("overall struct<count:long,accuracy:double,total_data_points:long>, per_language map<string, map<string, struct<count:long,accuracy:double>>>").json(path)
    each = whole.select("overall", F.explode("per_language").alias("language", "by")).select("overall", "language", F.explode("by").alias("question_type", "x"))
    return each.select("language", "question_type", "x.count", "x.accuracy", F.col("overall.count").alias("all_scores"), F.col("overall.accuracy").alias("all_accuracy"), F.col("overall.total_data_points").alias("rows"))


# ---------------------------------------------------------------- answers


def true_false_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's words for true and false, usual and other ones, with marks around them, by document."""
    pairs = [(lang, w) for lang, inner in sorted(TRUE_FALSE_SYNONYMS.items()) for w in inner] + [(lang, w) for lang, words in sorted(TRUE_FALSE_WORDS.items()) for w in words]
    k = (F.col("doc_id") % len(pairs) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), k)
    rows = _table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("language"), pick(1).alias("word"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "word", F.lit(". "))).when(F.col("doc_id") % 3 == 1, F.concat("word", F.lit("।"))).otherwise(F.col("word"))
    return rows.select("doc_id", "language", true_false(said, F.col("language")).alias("said"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each conversation as a page: a reply for each turn's picture, in order; some are blank."""
    boxes = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("image_path"))

    def make():
        see = stub_seeing()
        return lambda asked: [" " if x[0] in "01" else x.replace("a", "<br>") for x in see(asked)]

    return sections(boxes, "conv_id", "turn", make)


# ---------------------------------------------------------------- corpus and files


def final_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final corpus of rows with some of the working columns, which go; path parts come."""
    rows = _table(spark, sf_dir, "documents").select(F.format_string("root/%s/%s/%d.jpg", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?")), "doc_id").alias("image_path"), F.col("lang").alias("language"), F.lit("success").alias("status"), F.col("text").alias("caption"), F.col("text").alias("long_a"))
    return corpus.final(unions.union_all([rows, rows.drop("status", "caption").withColumn("state", F.lit("Goa"))]))


def csv_folder_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files with columns in other orders, some missing and one more, read by name."""
    path = scratch_path(spark, "csv-folder")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    forms = (["doc_id", "text", "lang", "source"], ["source", "lang", "doc_id", "text"], ["text", "doc_id"], ["lang", "doc_id", "text"])
    for i, names in enumerate(forms):
        part = rows.filter(F.col("doc_id") % len(forms) == i).select(*names)
        (part.withColumn("more", F.lit("x")) if i == 1 else part).write.mode("append").option("header", True).option("escape", '"').csv(path)
    return readers.csv_by_name(spark, path, "doc_id long, text string, lang string, source string, more string")


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as files that each hold a JSON array of a hundred records, read as records."""
    path = scratch_path(spark, "arrays")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit('"'), "text", F.lit('"\n')).alias("text"), F.when(F.col("item_id") % 2 == 0, F.col("item_id") / 4).alias("score"))
    each = F.to_json(F.sort_array(F.collect_list(F.struct("item_id", "text", "score"))), {"ignoreNullFields": "false"})
    files = rows.groupBy(F.expr("item_id div 100").alias("part")).agg(each.alias("value"))
    files.write.partitionBy("part").text(path)
    return readers.json_array(spark, f"{path}/part=*", "item_id long, text string, score double")


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, size and the rule for large sides, of the headers of PNG and JPEG files; some are cut short or other files."""
    key = F.col("doc_id")
    width, height = (F.lpad(F.hex(1 + key * n % 3000), 8, "0") for n in (7, 13))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), width, height, F.lit("0806000000"))
    other = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFDB0006"), F.lit("01020304FFC4000411"), F.lit("22"))
    jpeg = F.concat(other, F.lit("FFC2001108"), F.substring(height, 5, 4), F.substring(width, 5, 4), F.lit("03012200"))
    form = key % 5
    body = F.when(form == 0, png).when(form == 1, jpeg).when(form == 2, F.substring(png, 1, 40)).when(form == 3, F.concat(other, F.lit("FFDA0000"))).otherwise("47494638")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.unhex(body).alias("content"))
    size = image_size(F.col("content"))
    return rows.select("doc_id", image_format(F.col("content")).alias("format"), size["width"].alias("width"), size["height"].alias("height"), too_large(F.col("content")).alias("too_large"))


def verified_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofread pages with an image: their text, image and language."""
    rows = _table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    head = F.concat(F.lit('<p class="prp-page-qualityheader quality'), (F.col("page_id") % 3 + 3).cast("string"), F.lit('"></p>'))
    image = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<div class="prp-page-image"><span><img src="//img.example.org/'), key, F.lit('.jpg"></span></div>'))).otherwise("")
    page = F.concat(F.lit("<html>"), head, image, F.lit('<div class="pagetext x"> page '), key, F.lit("<p>two</p></div>"), F.coalesce("html", F.lit("")), F.lit("</html>"))
    return corpus.verified_pages(rows.withColumn("html", page))


def resumed_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields translated by a store of replies, first those of some rows and then of all: each text is asked once."""
    store = scratch_path(spark, "replies")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("note "), (F.col("item_id") % 4).cast("string"))).alias("note"))
    for part in (rows.filter("item_id % 2 = 0"), rows):
        told = translated_fields(part, ["text", "note"], stub_refusing, "Hindi", store, attempts=1, commits=2)
    asked = spark.read.parquet(store)
    once = asked.agg((F.count("*") == F.count_distinct("prompt_key")).alias("once"))
    return told.select("item_id", "text", "note", F.concat_ws(",", "failed_fields").alias("failed"), F.concat_ws("; ", "errors").alias("errors")).join(F.broadcast(once))  # one row


def large_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all events, whole rows, by a threshold of their draws."""
    rows = _table(spark, sf_dir, "events")
    return sampling.drawn(rows, "event_id", rows.count() // 3, seed=9).select("event_id", "user_id", "event_type", "value")


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a bucketed store into which their orders' priorities are merged in two rounds, the first one twice."""
    path = scratch_path(spark, "store")
    base = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("none").alias("priority"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).otherwise(" ").alias("priority"))
    first = orders.filter(F.col("o_orderkey") % 2 == 0)
    merged_into(path, first, "c_custkey", "o_orderkey", 16, start=base)
    merged_into(path, first, "c_custkey", "o_orderkey")
    merged_into(path, orders.filter(F.col("o_orderkey") % 2 == 1), "c_custkey", "o_orderkey")
    return spark.read.parquet(path).select("c_custkey", "c_name", "priority")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (ocr_report_of_scored, nested_report, ordered_report, report_file, true_false_words, page_sections, final_corpus, csv_folder_by_name, json_arrays, image_sizes, verified_corpus, resumed_translation, large_draw, stored_upsert)
}

_TYPED_SQL = f"""
    rows AS (SELECT {_LANGUAGE_SQL.format(key="conv_id")} AS language, CASE WHEN turn % 3 <> 0 THEN length(text) % 2 END AS mcq, CASE WHEN turn % 2 <> 0 THEN length(role) % 2 END AS tf FROM conversations),
    long AS (SELECT language, 'mcq' AS question_type, mcq AS score FROM rows UNION ALL SELECT language, 'true_false_q', tf FROM rows),
    typed AS (SELECT language, question_type, count(*) AS count, round(avg(score), 6) AS accuracy FROM long WHERE score IS NOT NULL GROUP BY ALL)
"""
_WORD_PAIRS = [(lang, w, usual) for lang, inner in sorted(TRUE_FALSE_SYNONYMS.items()) for w, usual in inner.items()] + [(lang, w, TRUE_FALSE_SYNONYMS.get(lang, {}).get(w, w)) for lang, words in sorted(TRUE_FALSE_WORDS.items()) for w in words]
_WORD_ROWS = ", ".join(f"({i}, '{lang}', '{usual}')" for i, (lang, _, usual) in enumerate(_WORD_PAIRS))

ORACLE_SQL: dict[str, str] = {
    "ocr_report_of_scored": f"""
        WITH events_scored AS (SELECT event_id, {_LANGUAGE_SQL.format(key="event_id")} AS language, CAST(CAST(abs(value) % 100 AS DECIMAL(10, 2)) AS DOUBLE) AS v FROM events WHERE event_id % 11 <> 5),
        scores AS (SELECT language, CASE WHEN event_id % 3 <> 0 AND language <> '{LANGUAGES[2]}' THEN v END AS w, CASE WHEN event_id % 4 <> 0 THEN v / 2 END AS c FROM events_scored),
        both_scores AS (SELECT language, w, CAST(c AS DECIMAL(28, 4)) AS c FROM scores WHERE w IS NOT NULL AND c IS NOT NULL)
        SELECT CASE WHEN grouping(language) = 1 THEN 'overall' ELSE 'language' END AS scope, language, count(*) AS count, round(avg(w), 6) AS avg_anls_word, round(avg(CAST(c AS DOUBLE)), 6) AS avg_anls_char
        FROM both_scores GROUP BY GROUPING SETS ((language), ())""",
    "nested_report": f"""
        WITH {_TYPED_SQL}
        SELECT language, max(CASE WHEN question_type = 'mcq' THEN count || '/' || format('{{:.4f}}', accuracy) END) AS mcq, max(CASE WHEN question_type <> 'mcq' THEN count || '/' || format('{{:.4f}}', accuracy) END) AS true_false_q, CAST(count(*) AS INTEGER) AS types
        FROM typed GROUP BY language""",
    "ordered_report": f"""
        WITH {_TYPED_SQL},
        every AS (SELECT 'language' AS scope, language, question_type, count FROM typed UNION ALL SELECT 'overall', NULL, NULL, count(score) FROM long)
        SELECT *, row_number() OVER (ORDER BY scope <> 'overall', language, question_type) - 1 AS place FROM every""",
    "report_file": f"""
        WITH {_TYPED_SQL}, overall AS (SELECT count(score) AS all_scores, round(avg(score), 6) AS all_accuracy, (SELECT count(*) FROM rows) AS rows FROM long)
        SELECT language, question_type, count, accuracy, all_scores, all_accuracy, rows FROM typed, overall""",
    "true_false_words": f"WITH words(k, language, said) AS (VALUES {_WORD_ROWS}) SELECT doc_id, language, said FROM documents JOIN words ON k = doc_id % {len(_WORD_PAIRS)}",
    "page_sections": """
        WITH told AS (SELECT conv_id, turn, md5('Read the text of this section.|' || conv_id || '/' || turn) AS h FROM conversations)
        SELECT conv_id, string_agg(replace(h, 'a', chr(10)), chr(10) ORDER BY turn, replace(h, 'a', '<br>')) AS text FROM told WHERE h[1:1] NOT IN ('0', '1') GROUP BY conv_id""",
    "final_corpus": """
        SELECT 'root/' || coalesce(source, '?') || '/' || coalesce(lang, '?') || '/' || doc_id || '.jpg' AS image_path, lang AS language, text AS long_a, coalesce(source, '?') AS "State/UT", coalesce(lang, '?') AS topic
        FROM documents, (SELECT unnest([1, 2]))""",
    "csv_folder_by_name": "SELECT doc_id, text, CASE WHEN doc_id % 4 <> 2 THEN lang END AS lang, CASE WHEN doc_id % 4 < 2 THEN source END AS source, CASE WHEN doc_id % 4 = 1 THEN 'x' END AS more FROM documents",
    "json_arrays": "SELECT item_id, '\"' || text || '\"' || chr(10) AS text, CASE WHEN item_id % 2 = 0 THEN item_id / 4 END AS score FROM benchmark",
    "image_sizes": """
        SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 2) THEN 'png' WHEN doc_id % 5 IN (1, 3) THEN 'jpeg' END AS format,
               CAST(CASE WHEN doc_id % 5 < 2 THEN 1 + doc_id * 7 % 3000 END AS INTEGER) AS width, CAST(CASE WHEN doc_id % 5 < 2 THEN 1 + doc_id * 13 % 3000 END AS INTEGER) AS height,
               doc_id % 5 < 2 AND (1 + doc_id * 7 % 3000 > 1080 OR 1 + doc_id * 13 % 3000 > 1080) AS too_large
        FROM documents""",
    "verified_corpus": "SELECT url AS page_url, 'page ' || page_id || chr(10) || 'two' AS text, 'https://img.example.org/' || page_id || '.jpg' AS image_url, substr(regexp_replace(url, '^https://', ''), 1, 2) AS lang FROM pages WHERE page_id % 3 = 1 AND page_id % 2 = 0",
    "resumed_translation": """
        WITH rows AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN ' ' ELSE 'note ' || item_id % 4 END AS note FROM benchmark),
        told AS (SELECT *, md5('Translate to Hindi: ' || text) AS t, md5('Translate to Hindi: ' || note) AS n, trim(note) <> '' AS asked FROM rows),
        seen AS (SELECT *, list_filter([CASE WHEN t < '4' THEN 'text' END, CASE WHEN asked AND n < '4' THEN 'note' END], lambda x: x IS NOT NULL) AS f FROM told)
        SELECT item_id, CASE WHEN t < '4' THEN text ELSE t END AS text, CASE WHEN NOT asked OR n < '4' THEN note ELSE n END AS note,
               array_to_string(f, ',') AS failed, array_to_string(list_transform(f, lambda x: x || ' - ValueError: refused'), '; ') AS errors, true AS once
        FROM seen""",
    "large_draw": "SELECT event_id, user_id, event_type, value FROM events ORDER BY md5(event_id || '|9'), event_id LIMIT (SELECT count(*) // 3 FROM events)",
    "stored_upsert": """
        WITH marked AS (SELECT o_custkey AS c_custkey, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority ELSE ' ' END AS priority FROM orders),
        one AS (SELECT * FROM marked WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) = 1),
        two AS (SELECT * FROM marked WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) = 1),
        base AS (SELECT coalesce(c.c_custkey, one.c_custkey) AS c_custkey, c_name, CASE WHEN c.c_custkey IS NULL THEN one.priority WHEN trim(one.priority) <> '' THEN one.priority ELSE 'none' END AS priority FROM customer c FULL JOIN one ON c.c_custkey = one.c_custkey)
        SELECT coalesce(base.c_custkey, two.c_custkey) AS c_custkey, c_name, CASE WHEN base.c_custkey IS NULL THEN two.priority WHEN trim(two.priority) <> '' THEN two.priority ELSE base.priority END AS priority
        FROM base FULL JOIN two ON base.c_custkey = two.c_custkey""",
}
