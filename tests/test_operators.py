import json

import pytest
from pyspark.sql import functions as F

from lathework import dims, providers
from lathework.operators import lookups, projections, reports, reshape, sampling, unions
from lathework.plans import corpus, evaluate, generate
from lathework.sources import readers, writers
from lathework.streaming import incremental


def test_samples_have_their_sizes(spark):
    rows = spark.range(0, 100).select("id", F.expr("CASE WHEN id < 2 THEN 'a' WHEN id < 5 THEN 'b' WHEN id < 9 THEN 'c' WHEN id = 99 THEN NULL ELSE 'd' END").alias("g"))
    got = sampling.stratified(rows, "g", "id", 3)
    assert {r.g: r.n for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 3, "c": 3, "d": 3}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.stratified(rows.repartition(7), "g", "id", 3).collect()))


def test_word_limit_is_strict(spark):
    rows = spark.createDataFrame([("x " * 10,), ("x " * 11,), (None,)], "text string")
    assert sampling.long_enough(rows, "text").count() == 1


def test_upsert(spark):
    base = spark.createDataFrame([("k1", "a", "b"), ("k1", "c", "d"), ("k2", "e", None)], "k string, x string, y string")
    changes = spark.createDataFrame([("k1", 1, "old", "Y"), ("k1", 2, "new", " "), ("k3", 1, "n", "")], "k string, s int, x string, y string")
    want = [("k1", "new", "b"), ("k1", "new", "d"), ("k2", "e", None), ("k3", "n", "")]
    once = lookups.upserted(base, changes, "k", "s")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, lookups.upserted(once, changes, "k", "s").collect()), key=str) == sorted(want, key=str)


def test_reports_leave_out_null_scores(spark):
    scores = spark.createDataFrame([("x", "mcq", 1.0), ("x", "mcq", None), ("y", "mcq", None)], "language string, question_type string, score double")
    got = {(r.scope, r.language): (r["count"], r.accuracy, r.total_data_points) for r in reports.typed_report(scores, 7, "accuracy").collect()}
    assert got == {("language", "x"): (1, 1.0, None), ("overall", None): (1, 1.0, 7)}
    empty = reports.typed_report(scores.filter("score > 5"), 7, "accuracy").collect()
    assert [(r.scope, r["count"], r.accuracy) for r in empty] == [("overall", 0, None)]
    mmt = spark.createDataFrame([("hi", 1.0, None), ("hi", 2.0, 0.5)], "target_language string, bleu double, ribes double")
    assert [tuple(r) for r in reports.mmt_report(mmt).collect()] == [("hi", 1, 2.0, 0.5)]


def test_ocr_report_of_infinite_and_missing_scores(spark):
    rows = [("x", 33.3333, 0.0625), ("x", 66.6667, 0.0), ("y", float("inf"), 1.0), ("y", 5.0, 2.0), ("z", None, 1.0)]
    got = {r.language: (r["count"], r.avg_anls_word, r.avg_anls_char) for r in reports.ocr_report(spark.createDataFrame(rows, "language string, anls_word double, anls_char double")).collect()}
    assert got == {"x": (2, 50.0, 0.031), "y": (2, float("inf"), 1.5), None: (4, float("inf"), 0.766)}


def test_unpivot_and_back(spark):
    rows = spark.createDataFrame([(1, "a", None)], "id int, hi string, bn string")
    assert sorted((r.target_language, r.reference_caption) for r in reshape.languages_long(rows, ["id"], ["hi", "bn"]).collect()) == [("bn", None), ("hi", "a")]


def test_rounds_retry_what_failed(spark):
    seen = []

    def work(rows, i):
        seen.append(rows.count())
        return rows.withColumn("status", F.when(F.col("id") <= i, "success").otherwise("failed"))

    got = unions.rounds(spark.range(4).select("id"), work, lambda df, _: df, most=3)
    assert seen == [4, 3, 2]
    assert {r.id: r.status for r in got.collect()} == {0: "success", 1: "success", 2: "success", 3: "failed"}


def test_a_failing_model_leaves_errors(spark):
    def make():
        def model(asked):
            if "bad" in asked[0][0]:
                raise RuntimeError("no")
            return ["5"]

        return model

    rows = spark.createDataFrame([("ok",), ("bad",), (None,)], "p string")
    got = {r.p: (r.reply, r.reply_error) for r in providers.answered(rows, make, "p").collect()}
    assert got == {"ok": ("5", None), "bad": (None, "RuntimeError: no"), None: (None, None)}
    assert [r.prediction for r in providers.prediction_text(providers.answered(rows.filter("p = 'bad'"), make, "p"), error_as_text=True).collect()] == ["[ERROR: RuntimeError: no]"]


def test_predictions_are_scored_end_to_end(spark):
    columns = ["id", "language", "State/UT", "topic", "source_url", "short_q1", "short_a1", "short_q2", "short_a2", "mcq", "mcq_a", "mcq_opt1", "mcq_opt2", "mcq_opt3", "mcq_opt4", "true_false_q", "true_false_a", "long_q", "long_a", "adversarial_question", "adversarial_answer"]
    samples = spark.createDataFrame([tuple(["1", "Hindi"] + ["v"] * 19), tuple(["2", "English"] + ["v"] * 3 + [""] * 16)], columns)
    told = generate.vqa(samples, "stub").cache()
    assert {r.id: r.predictions.long_answer for r in told.select("id", F.col("predictions").alias("predictions")).select("id", F.struct(F.col("predictions.long_a").alias("long_answer")).alias("predictions")).collect()}["2"] == ""
    assert {r.id: r.questions.mcq for r in told.collect()} == {"1": "v: v | v | v | v", "2": ":  |  |  | "}
    assert evaluate.structured(told).filter("scope = 'overall'").first().total_data_points == 2
    assert evaluate.open_ended(told).filter("scope = 'overall'").first()["count"] == 4
    assert generate.vqa(samples, "stub", language="HINDI").count() == 1
    assert generate.vqa(samples.unionAll(samples), "STUB").filter("id = '1'").count() == 2  # samples may share an id
    with pytest.raises(ValueError, match="no model named"):
        generate.vqa(samples, "nothing")
    report = evaluate.structured(told.withColumn("language", F.lit("Z")).unionAll(told)).collect()
    assert [r.scope for r in report] == ["overall"] + ["language"] * (len(report) - 1) and [r.language for r in report[1:]] == sorted(r.language for r in report[1:])


def scripted(replies):
    """A model that gives the replies one after the other, the last one again and again; an exception is raised."""

    def make():
        left = list(replies)

        def model(asked):
            one = left.pop(0) if len(left) > 1 else left[0]
            if isinstance(one, Exception):
                raise one
            return [one]

        return model

    return make


def test_a_judge_without_a_number_is_asked_again(spark):
    rows = spark.createDataFrame([("long_q", "q", "ref", "said")], "question_type string, question string, reference string, response string")
    score = lambda *replies: providers.judged(rows, scripted(replies)).first().score
    assert score("I think 7", "7") == 7.0 and score(RuntimeError("no"), "", "12") == 10.0
    assert score("a", "b", "c", "7") is None


def test_unusable_questions_are_asked_for_again(spark):
    good = json.dumps({"long_question": {"question": "l", "answer": "L"}})
    pair = "Adversarial Question: x\nAnswer: y"
    rows = spark.createDataFrame([("p1", "c", "u", "success")], "image_path string, caption string, source_url string, status string")
    status = lambda a, b: corpus.questioned(rows, scripted(a), scripted(b)).first().status
    assert status(["no json", "{}", f"```json\n{good}\n```"], ["Answer: y", pair]) == "success"
    assert status(["no json", "[]", "{}", good], [pair]) == "Standard QA failed"
    assert status([good], ["x", "Answer: y", "Adversarial Question: \nAnswer: y", pair]) == "Adversarial QA failed"


def test_published_images_are_bytes(spark, tmp_path):
    rows = projections.with_defaults(spark.createDataFrame([("/r/Goa/food/1.jpg",), ("/r/Goa/food/2.jpg",)], "image_path string"), [c for c in dims.PUBLISHED if c != "image_path"])
    images = spark.createDataFrame([("file:///r/Goa/food/1.jpg", bytearray(b"xyz"))], "path string, content binary")
    writers.publish(rows, str(tmp_path / "p"), images)
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.dtypes[0] == ("image", "struct<bytes:binary,path:string>") and got.columns == [dims.PUBLISHED_NAMES.get(c, c) for c in dims.PUBLISHED]
    assert {r.image.path: r.image.bytes for r in got.collect()} == {"/r/Goa/food/1.jpg": bytearray(b"xyz"), "/r/Goa/food/2.jpg": None}


def test_questions_have_a_status(spark):
    good = json.dumps({"long_question": {"question": "l", "answer": "L"}})
    rows = spark.createDataFrame([("p1", "c", "u", "success")], "image_path string, caption string, source_url string, status string")
    make = lambda reply: lambda: lambda asked: [reply]
    status = lambda a, b: corpus.questioned(rows, make(a), make(b)).first().status
    assert status(good, "Adversarial Question: x\nAnswer: y") == "success"
    assert status(good, "nothing") == "Adversarial QA failed"
    assert status("nothing", "nothing") == "Standard QA failed"


def test_corpus_tables(spark):
    rows = spark.createDataFrame([("r/Bihar/food/1.jpg",), ("r/Goa/food/2.jpg",), ("r/Kerala/art/3.jpg",)], "image_path string")
    got = {r.image_path: r.primary_language for r in corpus.sampled(rows).collect()}
    assert got == {"r/Bihar/food/1.jpg": "Hindi", "r/Kerala/art/3.jpg": "Malayalam"}
    assert corpus.final(rows.withColumn("language", F.lit("x"))).first()["topic"] == "food"
    wide = projections.with_defaults(rows, [c for c in dims.PUBLISHED if c != "image_path"])
    assert projections.published(wide).columns == [dims.PUBLISHED_NAMES.get(c, c) for c in dims.PUBLISHED]
    captions = corpus.captioned(spark.createDataFrame([("1.jpg", "u", "food")], "image_filename string, source_url string, category string"), "r", "Bihar", lambda df, _: df)
    assert captions.first().image_path == "r/Bihar/food/1.jpg" and captions.first().status == "success"


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a,\n\"b\"", "x")], "t string, u string")
    writers.csv(rows, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "t string, u string").collect() == rows.collect()
    (tmp_path / "lang").mkdir()
    (tmp_path / "lang" / "Hindi_corrected.csv").write_text("a\n1\n")
    (tmp_path / "lang" / "other.csv").write_text("a\n2\n")
    assert [tuple(r) for r in readers.csv_by_language(spark, str(tmp_path / "lang"), schema="a string").collect()] == [("1", "Hindi")]
    assert sorted(r.state for r in readers.csv_by_state(spark, str(tmp_path / "lang"), "a string").collect()) == ["Hindi_corrected", "other"]
    (tmp_path / "p.json").write_text(json.dumps([{"id": "1", "language": "é"}], indent=1))
    assert readers.json_array(spark, str(tmp_path / "p.json"), "id string, language string").first().language == "é"
    (tmp_path / "d.xml").write_text("<m xmlns='u'><page><title>A b</title><x/></page><page><title></title></page><page><y/></page></m>")
    assert [tuple(r) for r in readers.dump_urls(spark, {"Hindi": str(tmp_path / "d.xml"), "Tamil": str(tmp_path / "none.xml")}, dims.DUMP_LANGUAGES).collect()] == [("Hindi", "https://hi.wikisource.org/wiki/A_b")]
    assert json.loads(writers.json_text(rows)) == [{"t": "a,\n\"b\"", "u": "x"}]
    pages = readers.fetched(spark.createDataFrame([("u1",), ("bad",)], "url string"), lambda urls: [("h", None) if u != "bad" else (None, "404") for u in urls])
    assert {r.url: (r.html, r.error) for r in pages.collect()} == {"u1": ("h", None), "bad": (None, "404")}


def test_stream_resumes(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id string, language string, reference_text string, predicted_text string"
    make = lambda i: spark.createDataFrame([(str(i), "x", "a b", "a c")], schema).write.mode("append").json(source)
    for i in range(2):
        make(i)
        incremental.score_stream(spark, source, schema, evaluate.score_ocr, sink, mark)
        assert spark.read.parquet(sink).count() == i + 1
    assert spark.read.parquet(sink).select("anls_word").distinct().collect()[0][0] == 50.0


def test_translation_keeps_what_fails(spark):
    def make():
        def model(asked):
            if "bad" in asked[0][0]:
                raise RuntimeError("no")
            return ["T"]

        return model

    rows = spark.createDataFrame([("1", "x", "bad", " ", None)], "id string, a string, b string, c string, d string")
    got = providers.translated(rows, ["a", "b", "c", "d"], make, "Hindi").first()
    assert (got.a, got.b, got.c, got.d, got.failed_fields) == ("T", "bad", " ", None, ["b"])
    assert got.errors == ["b - RuntimeError: no"]


def test_sections_become_one_text(spark):
    boxes = spark.createDataFrame([("p", 2, "i2"), ("p", 1, "i1"), ("p", 3, "")], "page string, place int, image_path string")
    make = lambda: lambda asked: [f"{asked[0][1]}<br>x" if asked[0][1] else " "]
    assert [tuple(r) for r in providers.sections(boxes, "page", "place", make).collect()] == [("p", "i1\nx\ni2\nx")]


def test_unknown_model_is_an_error():
    with pytest.raises(ValueError, match="no model named"):
        providers.maker("nothing")
    assert providers.maker("STUB") is providers.stub


def test_spread_makes_more_tasks_of_more_rows(spark, tmp_path):
    """A file of one row group, which its splits can't cut, as tasks of a bounded number of rows; a part of it over the cores at least."""
    from lathework.operators.spread import ROWS, spread

    n, cores = 9 * ROWS, spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, 1).selectExpr("id", "md5(string(id)) t").write.parquet(str(tmp_path / "one"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)  # splits without a row group
    try:
        dealt = spread(spark.read.parquet(str(tmp_path / "one")))
        per_task = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per_task) == n == dealt.select("id").distinct().count() and max(per_task) <= 1.1 * ROWS
        few = spread(dealt.filter("id < 100"))
        assert few.rdd.getNumPartitions() == cores and few.count() == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
