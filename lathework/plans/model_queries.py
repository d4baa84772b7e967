"""Queries over generation, models, rounding and files, with DuckDB SQL for the same rows beside them.

Models are stubs whose replies only depend on the prompt's MD5, so that SQL can say what each replies; files
are written to the shared folder and read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import QUESTIONS, TARGET_LANGUAGES, TRUE_FALSE_WORDS
from ..functions.prompts import JUDGE_KINDS, caption_prompt, question_prompt
from ..functions.text import SPACE, pre_process, rounded
from ..operators import reports
from ..providers import Provider, stub_refusing, stub_seeing_refusing, translated
from ..sources import readers, writers
from ..sources.scratch import scratch_path, stored
from . import corpus, evaluate, generate

LANGUAGES = sorted(TRUE_FALSE_WORDS)
_LANGUAGE_SQL = "[" + ", ".join(f"'{x}'" for x in LANGUAGES) + "][CAST(item_id % 11 + 1 AS INTEGER)]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.parquet(spark, f"{sf_dir}/{name}.parquet")


def _said(prompt: str, failed: str, image: str = "") -> str:
    """SQL of the refusing stub's reply to a prompt, with what stands for a failure; with an image that of the one that sees it."""
    seen = f"md5({prompt} || '|' || {image})" if image else f"md5({prompt})"
    return f"CASE WHEN {seen}[1:1] < '4' THEN {failed} ELSE {seen} END"


# ---------------------------------------------------------------- rounding and text


def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rounded to one to four places; sixteenths are exact, so that many are ties."""
    part = F.col("event_id") / 16
    return _table(spark, sf_dir, "events").select("event_id", rounded(part, 3).alias("tie3"), rounded(-part, 1).alias("tie1"), rounded(F.col("value") / 7, 4).alias("r4"), rounded(F.col("value"), 2).alias("r2"))


def processed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between white space of several kinds, and missing ones, as scoring takes them."""
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  \n"), "text", F.lit("\t　 "))).when(F.col("turn") % 4 == 1, F.lit(None)).when(F.col("turn") % 4 == 2, F.concat("text", F.lit("\n​"))).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", pre_process(text).alias("text"))


# ---------------------------------------------------------------- generation


def _image(item: Column) -> Column:
    return F.concat(F.lit("img/"), (item % 5).cast("string"), F.lit("/"), item.cast("string"), F.lit(".jpg"))


_IMAGE = "('img/' || item_id % 5 || '/' || item_id || '.jpg')"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each item, without a second short question or a long one."""
    item = F.col("item_id")
    told = lambda name: F.concat(F.lit(f"{name} "), item.cast("string"))
    questions = {"short_q1": F.col("text"), "short_q2": F.lit(""), "mcq": told("which"), "true_false_q": F.col("text"), "long_q": F.lit(None).cast("string"), "adversarial_question": F.col("text")}
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (item % len(LANGUAGES) + 1).cast("int"))
    return _table(spark, sf_dir, "benchmark").select(
        (item % 17).cast("string").alias("id"), "item_id", language.alias("language"), F.lit("a state").alias("State/UT"), F.lit("a topic").alias("topic"), item.cast("string").alias("source_url"), _image(item).alias("image"),
        *(c.alias(q) for q, c in questions.items()), *(told(o).alias(o) for o in generate.OPTIONS), *(told(a).alias(a) for a in QUESTIONS.values()),
    )


def vqa_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model by its name, which sees each sample's image; failures as text. Several samples share an id."""
    told = generate.vqa(_samples(spark, sf_dir), "stub-seeing-refusing", error_as_text=True)
    return told.select("model", "id", "language", "source_url", F.col("questions.mcq").alias("mcq"), *(F.col(f"predictions.{a}").alias(f"said_{a}") for a in QUESTIONS.values()), F.col("references.mcq_a").alias("mcq_a"))


def mmt_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation of each item to each target language beside its image, null where the model failed."""
    captions = [F.concat(F.lit(f"{i}:"), "text").alias(x) for i, x in enumerate(TARGET_LANGUAGES)]
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("here").alias("source_url"), F.col("text").alias("English"), _image(F.col("item_id")).alias("image"), *captions)
    return generate.mmt(rows, "stub-seeing-refusing")


def ocr_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt for all pages, each with its own image: a reply for each page."""
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("Hindi").alias("language"), F.col("url").alias("page_url"), F.col("url").alias("image"), F.col("html").alias("text"))
    return generate.ocr(rows, "stub-seeing").select("model", "id", "language", "page_url", F.length("reference_text").cast("long").alias("chars"), "predicted_text")


def translated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields translated one by one: blank ones stay, failed ones keep their text and are listed."""
    note = F.when(F.col("item_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("note "), F.col("item_id").cast("string")))
    told = translated(_table(spark, sf_dir, "benchmark").select("item_id", "text", note.alias("note")), ["text", "note"], stub_refusing, "Hindi")
    return told.select("item_id", "text", "note", F.concat_ws(",", "failed_fields").alias("failed"), F.concat_ws("; ", "errors").alias("errors"))


def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts for captions, with and without a known one, and for questions about them by file and category."""
    given = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, "")
    return _table(spark, sf_dir, "benchmark").select("item_id", caption_prompt(F.lit("Goa"), F.lit("art"), given).alias("caption"), question_prompt(F.col("text"), file=F.format_string("%d.jpg", "item_id"), category=F.lit("art")).alias("standard"), question_prompt(F.col("text"), True, F.lit("x.jpg"), F.lit("art")).alias("adversarial"), question_prompt(F.col("text")).alias("plain"))


def caption_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions in two rounds, each stored; what fails in both stays as failed."""
    rows = _table(spark, sf_dir, "benchmark").select(F.format_string("%d.jpg", "item_id").alias("image_filename"), F.lit("here").alias("source_url"), F.lit("art").alias("category"), F.col("text").alias("caption"))
    return corpus.captioned(rows, "root", "Goa", stored, stub_seeing_refusing, most_rounds=2)


def _standard() -> Provider:
    """JSON, in a fence for some prompts, and no JSON for others."""

    def reply(asked):
        for p, image in asked:
            h = hashlib.md5(f"{p}|{image}".encode()).hexdigest()
            body = f'{{"short_questions":[{{"question":"{h}","answer":"a"}}],"multiple_choice_questions":[{{"question":"m","answer":"B","options":["x","y"]}}],"long_question":{{"question":"l","answer":"{h[:4]}"}}}}'
            yield "no idea" if h[0] < "4" else f"```json\n{body}\n```" if h[0] < "8" else body

    return lambda asked: list(reply(asked))


def _adversarial() -> Provider:
    """Both lines, or the question's alone."""
    return lambda asked: [f"Sure.\nAdversarial Question: {h}" + ("" if h[0] < "4" else f"\nAnswer: no {h[:2]}") for h in (hashlib.md5(f"{p}|{image}".encode()).hexdigest() for p, image in asked)]


def qa_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers about each item's image and text, with the status that the replies give."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", _image(F.col("item_id")).alias("image_path"), F.col("text").alias("caption"), F.lit("success").alias("status"))
    return corpus.questioned(rows, _standard, _adversarial).select("item_id", "status", "short_q1", "short_a2", "mc_opt1_2", "mc_opt1_3", "long_a", "adversarial_question", "adversarial_answer")


# ---------------------------------------------------------------- scores


def open_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's score of every open question of nested predictions; null where there is nothing to compare."""
    item = F.col("item_id")
    struct = lambda values: F.struct(*(v.alias(k) for k, v in values.items()))
    questions, answers = list(QUESTIONS), list(QUESTIONS.values())
    rows = _table(spark, sf_dir, "benchmark").select(
        item.cast("string").alias("id"), F.lit("Hindi").alias("language"), struct({q: F.lit(f"{q}?") for q in questions}).alias("questions"),
        struct({a: F.when(item % (i + 3) != 0, F.concat(F.lit(f"{i}:"), "text")).otherwise(" ") for i, a in enumerate(answers)}).alias("predictions"),
        struct({a: F.when(item % (i + 2) != 0, "yes") for i, a in enumerate(answers)}).alias("references"),
    )
    return evaluate.score_open(rows)


def mmt_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of captions against themselves, some missing: none of these has a score."""
    text = F.col("text")
    rows = _table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 3 != 0, text).alias("reference_caption"), F.when(F.col("turn") % 2 == 0, text).alias("predicted_caption"))
    return evaluate.score_mmt(rows).groupBy(F.col("reference_caption").isNull().alias("no_reference"), F.col("predicted_caption").isNull().alias("no_prediction")).agg(F.count("*").alias("n"), F.count("bleu").alias("n_bleu"), F.count("ribes").alias("n_ribes"))


def status_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_table(spark, sf_dir, "events"), "event_type")


# ---------------------------------------------------------------- files


def _told(text: Column) -> Column:
    """A text with quotes, commas and line breaks within."""
    return F.concat(F.lit('said "'), text, F.lit('", \nthen'))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV files and back, whole texts with quotes and line breaks."""
    path = scratch_path(spark, "csv")
    writers.csv(_table(spark, sf_dir, "documents").select("doc_id", _told(F.col("text")).alias("text"), "lang"), path)
    return readers.csv(spark, path, "doc_id long, text string, lang string")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with nested fields as JSON lines and back; nulls are there."""
    path = scratch_path(spark, "json")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.struct(_told(F.col("text")).alias("said"), F.when(F.col("item_id") % 2 == 0, "x").alias("x")).alias("reply"))
    writers.json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path).select("item_id", "reply.said", "reply.x")


def split_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by status as two CSV files and back; a null status counts as failed."""
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    status = F.when(F.col("event_id") % 3 == 0, "success").when(F.col("event_id") % 3 == 1, "failed")
    writers.by_status(_table(spark, sf_dir, "events").select("event_id", "event_type", status.alias("status")), good, bad)
    schema = "event_id long, event_type string, status string"
    return readers.csv(spark, good, schema).withColumn("file", F.lit("success")).unionAll(readers.csv(spark, bad, schema).withColumn("file", F.lit("failed")))


def dump_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the titles of an XML dump, beside one that is missing; empty titles are left out."""
    path = scratch_path(spark, "dump")
    title = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.format_string("Page %d of %s/a&b", "doc_id", "source"))
    _table(spark, sf_dir, "documents").select(title.alias("title"), F.lit(0).alias("ns")).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return readers.dump_urls(spark, {"Hindi": path, "Tamil": f"{path}-missing"}, {"Hindi": "hi", "Tamil": "ta"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rounded_values, processed_texts, vqa_predictions, mmt_predictions, ocr_predictions, translated_items, generation_prompts, caption_rounds,
        qa_enrichment, open_scores, mmt_missing, status_count, csv_round_trip, json_round_trip, split_round_trip, dump_urls,
    )
}

_EDGE = "[" + SPACE[1:-1].replace(r"\u", "") + "]"
for _code in ("0009", "000D", "001C", "0020", "0085", "00A0", "1680", "2000", "200A", "2028", "2029", "202F", "205F", "3000"):
    _EDGE = _EDGE.replace(_code, rf"\x{{{_code}}}")
_LISTED = " || ".join(f"chr(10) || '{letter}) {o} ' || item_id" for letter, o in zip("ABCD", generate.OPTIONS, strict=True))
_WORDS = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in TRUE_FALSE_WORDS.items())
_REFUSED = "'[ERROR: ValueError: refused]'"
_OPEN = [(i, q) for i, q in enumerate(QUESTIONS) if q in evaluate.OPEN_TYPES]
_RULES = {q: JUDGE_KINDS["short" if "short" in q else "adversarial" if "adversarial" in q else "long"] for _, q in _OPEN}

ORACLE_SQL: dict[str, str] = {
    "rounded_values": "SELECT event_id, CAST(format('{:.3f}', event_id / 16) AS DOUBLE) AS tie3, CAST(format('{:.1f}', -(event_id / 16)) AS DOUBLE) AS tie1, CAST(format('{:.4f}', value / 7) AS DOUBLE) AS r4, CAST(format('{:.2f}', value) AS DOUBLE) AS r2 FROM events",
    "processed_texts": f"""
        SELECT conv_id, turn, regexp_replace(replace(coalesce(CASE turn % 4 WHEN 0 THEN ' ' || chr(160) || chr(10) || text || chr(9) || chr(12288) || chr(8232) WHEN 1 THEN NULL WHEN 2 THEN text || chr(10) || chr(8203) ELSE text END, 'None'), chr(10), ' '), '^{_EDGE}+|{_EDGE}+$', '', 'g') AS text
        FROM conversations""",
    "vqa_predictions": f"""
        WITH words AS (SELECT * FROM (VALUES {_WORDS}) w(language, yes, no)),
        asked AS (
            SELECT item_id, language, 'Reply with one option alone, as <A>, <B>, <C> or <D>.' || chr(10) || 'which ' || item_id || {_LISTED} AS m,
                   trim(text) || ' Keep the answer short, in ' || language || '.' AS s, 'Reply with one word alone, ' || yes || ' or ' || no || '.' || chr(10) || trim(text) AS t, trim(text) || ' Explain in detail, in ' || language || '.' AS l
            FROM (SELECT *, {_LANGUAGE_SQL} AS language FROM benchmark) JOIN words USING (language))
        SELECT 'stub-seeing-refusing' AS model, CAST(item_id % 17 AS VARCHAR) AS id, language, CAST(item_id AS VARCHAR) AS source_url,
               'which ' || item_id || ': ' || {" || ' | ' || ".join(f"'{o} ' || item_id" for o in generate.OPTIONS)} AS mcq,
               {_said("s", _REFUSED, _IMAGE)} AS said_short_a1, '' AS said_short_a2, {_said("m", _REFUSED, _IMAGE)} AS said_mcq_a, {_said("t", _REFUSED, _IMAGE)} AS said_true_false_a, '' AS said_long_a, {_said("l", _REFUSED, _IMAGE)} AS said_adversarial_answer, 'mcq_a ' || item_id AS mcq_a
        FROM asked""",
    "mmt_predictions": " UNION ALL ".join(f"SELECT 'stub-seeing-refusing' AS model, CAST(item_id AS VARCHAR) AS id, '{x}' AS target_language, 'here' AS source_url, text AS english_caption, '{i}:' || text AS reference_caption, {_said(f"('Translate this caption to {x}, nothing else: ' || text)", 'NULL', _IMAGE)} AS predicted_caption FROM benchmark" for i, x in enumerate(TARGET_LANGUAGES)),
    "ocr_predictions": "SELECT 'stub-seeing' AS model, CAST(page_id AS VARCHAR) AS id, 'Hindi' AS language, url AS page_url, length(html) AS chars, md5('Write down the text of this page.|' || coalesce(url, '')) AS predicted_text FROM pages",
    "translated_items": """
        WITH rows AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN ' ' ELSE 'note ' || item_id END AS note FROM benchmark),
        told AS (SELECT *, md5('Translate to Hindi: ' || text) AS t, md5('Translate to Hindi: ' || note) AS n, trim(note) <> '' AS asked FROM rows),
        seen AS (SELECT *, list_filter([CASE WHEN t[1:1] < '4' THEN 'text' END, CASE WHEN asked AND n[1:1] < '4' THEN 'note' END], lambda x: x IS NOT NULL) AS f FROM told)
        SELECT item_id, CASE WHEN t[1:1] < '4' THEN text ELSE t END AS text, CASE WHEN NOT asked OR n[1:1] < '4' THEN note ELSE n END AS note,
               array_to_string(f, ',') AS failed, array_to_string(list_transform(f, lambda x: x || ' - ValueError: refused'), '; ') AS errors
        FROM seen""",
    "generation_prompts": """
        SELECT item_id, 'Describe the picture in some sentences. Place:Goa Topic:art' || CASE WHEN item_id % 3 = 0 AND text <> '' THEN ' Known:' || text ELSE '' END AS caption,
               'Write JSON with short_questions, multiple_choice_questions with options, true_false_question and long_question.' || chr(10) || 'File: ' || item_id || '.jpg' || chr(10) || 'Category: art' || chr(10) || text AS standard,
               'Write one question with a false premise and its answer, as lines ''Adversarial Question:'' and ''Answer:''.' || chr(10) || 'Category: art' || chr(10) || text AS adversarial,
               'Write JSON with short_questions, multiple_choice_questions with options, true_false_question and long_question.' || chr(10) || text AS plain
        FROM benchmark""",
    "caption_rounds": f"""
        WITH asked AS (SELECT item_id, 'Describe the picture in some sentences. Place:Goa Topic:art Known:' || text AS p FROM benchmark)
        SELECT 'root/Goa/art/' || item_id || '.jpg' AS image_path, {_said("p", "NULL", "'root/Goa/art/' || item_id || '.jpg'")} AS caption, 'here' AS source_url, {_said("p", "'failed'", "'root/Goa/art/' || item_id || '.jpg'").split(" ELSE ")[0]} ELSE 'success' END AS status FROM asked""",
    "qa_enrichment": f"""
        WITH asked AS (
            SELECT item_id, md5('Write JSON with short_questions, multiple_choice_questions with options, true_false_question and long_question.' || chr(10) || 'File: ' || item_id || '.jpg' || chr(10) || 'Category: ' || item_id % 5 || chr(10) || text || '|' || {_IMAGE}) AS h,
                   md5('Write one question with a false premise and its answer, as lines ''Adversarial Question:'' and ''Answer:''.' || chr(10) || 'Category: ' || item_id % 5 || chr(10) || text || '|' || {_IMAGE}) AS g FROM benchmark),
        judged AS (SELECT *, h[1:1] >= '4' AS ok, h[1:1] >= '4' AND g[1:1] >= '4' AS good FROM asked)
        SELECT item_id, CASE WHEN NOT ok THEN 'Standard QA failed' WHEN NOT good THEN 'Adversarial QA failed' ELSE 'success' END AS status,
               CASE WHEN ok THEN h ELSE '' END AS short_q1, '' AS short_a2, CASE WHEN ok THEN 'y' ELSE '' END AS mc_opt1_2, '' AS mc_opt1_3, CASE WHEN ok THEN h[1:4] ELSE '' END AS long_a,
               CASE WHEN good THEN g ELSE '' END AS adversarial_question, CASE WHEN good THEN 'no ' || g[1:2] ELSE '' END AS adversarial_answer
        FROM judged""",
    "open_scores": " UNION ALL ".join(
        f"SELECT CAST(item_id AS VARCHAR) AS id, 'Hindi' AS language, '{q}' AS question_type, CASE WHEN item_id % {i + 3} <> 0 AND item_id % {i + 2} <> 0 THEN CAST(CAST('0x' || md5('{_RULES[q]}' || chr(10) || 'Question: {q}?' || chr(10) || 'Reference: yes' || chr(10) || 'Answer: {i}:' || text || chr(10) || 'Reply with a number from 0 to 10 alone.')[1:6] AS BIGINT) % 11 AS DOUBLE) END AS score FROM benchmark"
        for i, q in _OPEN
    ),
    "mmt_missing": "SELECT conv_id % 3 = 0 AS no_reference, turn % 2 <> 0 AS no_prediction, count(*) AS n, count(CASE WHEN conv_id % 3 <> 0 AND turn % 2 = 0 THEN 1 END) AS n_bleu, count(CASE WHEN conv_id % 3 <> 0 AND turn % 2 = 0 THEN 1 END) AS n_ribes FROM conversations GROUP BY ALL",
    "status_count": "SELECT event_type, count(*) AS count FROM events GROUP BY event_type",
    "csv_round_trip": "SELECT doc_id, 'said \"' || text || '\", ' || chr(10) || 'then' AS text, lang FROM documents",
    "json_round_trip": "SELECT item_id, 'said \"' || text || '\", ' || chr(10) || 'then' AS said, CASE WHEN item_id % 2 = 0 THEN 'x' END AS x FROM benchmark",
    "split_round_trip": "SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' END AS status, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'failed' END AS file FROM events",
    "dump_urls": "SELECT 'Hindi' AS language, 'https://hi.wikisource.org/wiki/Page_' || doc_id || '_of_' || source || '/a%26b' AS url FROM documents WHERE doc_id % 5 <> 0",
}
