"""Jobs over copies of the tables that grow, stop midway and run again."""

import json
import os
import subprocess
import sys

import pytest
from conftest import ROOT, canonical
from pyspark.sql import functions as F

from jobs import queries, review_corpus, translate_corpus
from lathework import providers
from lathework.sources import stores
from lathework.streaming import resume


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_job_query_equals_sql(spark, small, duck, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    ours = canonical(queries.QUERIES[name](spark, small).toPandas())
    assert ours == canonical(duck.sql(queries.ORACLE_SQL[name]).df())
    assert before == {k: spark.conf.get(k, None) for k in before} and not spark.streams.active


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def put(spark, path, rows, schema="doc_id long, text string, lang string, source string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def counting(log):
    """A maker of a provider that writes down each prompt it is asked, and refuses what ends in 'bad'."""

    def make():
        def reply(asked):
            if any(p.endswith("bad") for p, _ in asked):
                if len(asked) > 1:
                    raise ValueError("one of these")
            with open(log, "a") as f:
                f.writelines(json.dumps(p) + "\n" for p, _ in asked)
            if asked[0][0].endswith("bad"):
                raise ValueError("bad")
            return [p.upper() for p, _ in asked]

        return reply

    return make


def asked(log):
    return sorted(map(json.loads, open(log))) if os.path.exists(log) else []


def test_translation_takes_new_files_alone(spark, tmp_path):
    log, source = str(tmp_path / "log"), tmp_path / "documents.parquet"
    providers.register("counting", counting(log))
    config = {"source": str(source), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check"), "model": "counting", "attempts": 2, "wait_seconds": 0.0, "files_per_batch": 1}
    put(spark, source, [(1, "one", "en"), (2, "one", "de"), (3, " ", None), (4, None, ""), (5, "it is bad", "en"), (5, "it is bad", "en")], "doc_id long, text string, lang string")
    first = translate_corpus.run(spark, config)
    assert first["rows"] == {"blank": 2, "failed": 2, "translated": 2}
    once, there = asked(log), files(tmp_path / "out")
    assert once == ["Translate to Hindi: it is bad"] * 2 + ["Translate to Hindi: one"]  # one text of two rows once, the failed one twice
    assert translate_corpus.run(spark, config) == first | {"batches": 0} and files(tmp_path / "out") == there and asked(log) == once
    put(spark, source, [(6, "two", "en"), (7, "one", "en")], "doc_id long, text string, lang string")
    put(spark, source, [(8, "three", "fr")], "doc_id long, text string, lang string")
    assert translate_corpus.run(spark, config)["rows"] == {"blank": 2, "failed": 2, "translated": 5}
    assert asked(log) == sorted([*once, "Translate to Hindi: two", "Translate to Hindi: three"])
    rows = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert sorted((r.key, r.text, r.status) for r in rows.collect()) == sorted(
        [(1, "TRANSLATE TO HINDI: ONE", "translated"), (2, "TRANSLATE TO HINDI: ONE", "translated"), (3, " ", "blank"), (4, None, "blank"), (5, "it is bad", "failed"), (5, "it is bad", "failed"), (6, "TRANSLATE TO HINDI: TWO", "translated"), (7, "TRANSLATE TO HINDI: ONE", "translated"), (8, "TRANSLATE TO HINDI: THREE", "translated")], key=str
    )
    assert {(r.key, r.group) for r in rows.collect()} >= {(3, None), (4, "")}
    assert set(os.listdir(tmp_path / "out" / "rows")) >= {"batch=0", "batch=1", "batch=2"}
    assert rows.groupBy("status").count().count() == 3 and all(f in files(tmp_path / "out") for f in there if "report" not in f)


def test_a_stopped_translation_asks_no_committed_prompt_again(spark, tmp_path):
    """The run is stopped in a part by a prompt that ends it; the next run asks only what wasn't committed."""
    log, stop = str(tmp_path / "log"), str(tmp_path / "stop")
    open(stop, "w").close()

    plain = counting(log)

    def make():
        inner = plain()

        def reply(prompts):
            if os.path.exists(stop) and any("w17" in p for p, _ in prompts):
                raise SystemExit("stopped")
            return inner(prompts)

        return reply

    rows = spark.createDataFrame([(i, f"w{i % 20}") for i in range(60)], "id long, prompt string")
    store = str(tmp_path / "store")
    with pytest.raises(Exception):
        resume.replied(rows, make, "prompt", store, commits=6)
    committed = {r.reply.lower() for r in spark.read.parquet(store).collect()} if os.path.exists(store) else set()
    assert 0 < len(committed) < 20
    os.remove(stop)
    os.remove(log) if os.path.exists(log) else None
    got = resume.replied(rows, make, "prompt", store, commits=6)
    assert sorted((r.id, r.reply) for r in got.collect()) == [(i, f"W{i % 20}") for i in range(60)]
    assert sorted(asked(log)) == sorted({f"w{i}" for i in range(20)} - committed)
    again = len(asked(log))
    assert resume.replied(rows, make, "prompt", store).filter("reply IS NULL").count() == 0 and len(asked(log)) == again


def test_failed_replies_are_asked_again_where_wanted(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "x bad"), (2, "y"), (3, None)], "id long, prompt string")
    got = {r.id: (r.reply, r.reply_error) for r in resume.replied(rows, counting(log), "prompt", store, attempts=1).collect()}
    assert got == {1: (None, "ValueError: bad"), 2: ("Y", None), 3: (None, None)}
    fixed = {r.id: (r.reply, r.reply_error) for r in resume.replied(rows, providers.stub, "prompt", store, retry_failed=True).collect()}
    assert fixed[2] == ("Y", None) and fixed[1][1] is None and len(fixed[1][0]) == 32
    assert resume.replied(rows.limit(0), counting(log), "prompt", str(tmp_path / "none")).columns == ["id", "prompt", "reply", "reply_error"]


def test_reviews_rewrite_only_what_they_touch(spark, tmp_path):
    source, reviews, out = tmp_path / "documents.parquet", tmp_path / "labels.parquet", tmp_path / "out"
    config = {"source": str(source), "reviews": str(reviews), "output": str(out), "buckets": 8, "order": "seq"}
    label = "doc_id long, quality int, toxic int, seq string"
    put(spark, source, [(i, f"text {i}", "en" if i % 2 else None, "s") for i in range(40)])
    put(spark, source, [(7, "another text of 7", "de", "s")])
    put(spark, reviews, [(1, 1, 0, "1"), (1, 0, None, "2"), (7, 1, 1, "1"), (99, None, 1, "1"), (None, 1, 1, "1")], label)
    first = review_corpus.run(spark, config)
    assert first["rows"] == {"Not done yet": 38, "done": 4}
    there = files(out / "store") + files(out / "published")
    assert review_corpus.run(spark, config) == first | {"buckets": [], "languages": []}
    assert files(out / "store") + files(out / "published") == there
    put(spark, reviews, [(2, 1, 1, "1"), (1, 0, None, "3")], label)
    put(spark, source, [(50, "new", "en", "s"), (2, "late text of 2", "en", "s")])
    second = review_corpus.run(spark, config)
    assert 1 <= len(second["buckets"]) <= 2 and second["rows"] == {"Not done yet": 38, "done": 5}
    kept = [f for f in there if "/store/" in f and int(f.split("/bucket=")[1].split("/")[0]) not in second["buckets"]]
    assert set(kept) <= set(files(out / "store")) and len(kept) > 0
    got = {(r.key, r.text): (r.quality, r.toxic, r.edit_status) for r in spark.read.parquet(str(out / "published")).collect()}
    assert got[1, "text 1"] == ("0", "", "done") and got[7, "text 7"] == got[7, "another text of 7"] == ("1", "1", "done")
    assert got[99, None] == (None, "1", "done") and got[2, "text 2"] == ("1", "1", "done") and got[50, "new"] == ("", "", "Not done yet") and (2, "late text of 2") not in got


def test_a_publication_that_is_missing_is_made_again(spark, tmp_path):
    import shutil

    put(spark, tmp_path / "d.parquet", [(1, "a", "en", "s"), (2, "b", "7", "s")])
    put(spark, tmp_path / "l.parquet", [(1, 1, 0)], "doc_id long, quality int, toxic int")
    config = {"source": str(tmp_path / "d.parquet"), "reviews": str(tmp_path / "l.parquet"), "output": str(tmp_path / "out")}
    want = review_corpus.run(spark, config)
    shutil.rmtree(tmp_path / "out" / "published")
    assert review_corpus.run(spark, config) == want | {"buckets": []}


def test_store_is_created_by_changes_and_keeps_other_values(spark, tmp_path):
    path = str(tmp_path / "store")
    change = lambda rows: spark.createDataFrame(rows, "k string, s int, x string, y double")
    assert len(stores.merged_into(path, change([("a", 1, "old", 1.0), ("a", 2, "new", None), (None, 1, "z", 0.0), ("b", 1, "", 2.0)]), "k", "s", 4)) in (1, 2)
    rows = lambda: sorted((r.k, r.x, r.y) for r in spark.read.parquet(path).collect())
    assert rows() == [("a", "new", None), ("b", "", 2.0)]
    assert stores.merged_into(path, change([("a", 5, "new", None), ("b", 9, " ", 2.0)]), "k", "s", 99) == []
    assert len(stores.merged_into(path, change([("a", 5, "", 3.5), ("c", 1, None, None)]), "k", "s")) in (1, 2)
    assert rows() == [("a", "new", 3.5), ("b", "", 2.0), ("c", None, None)]
    assert stores.merged_into(path, change([("c", 1, None, None)]), "k", "s") == []
    assert stores.table_if_there(spark, str(tmp_path / "nothing")) is None


def test_command_line_runs_a_job_and_refuses_unknown_settings(tmp_path, small):
    env = os.environ | {"PYTHONPATH": ROOT}
    settings = {"source": f"{small}/documents.parquet", "reviews": f"{small}/labels.parquet", "output": str(tmp_path / "out"), "buckets": 4}
    (tmp_path / "config.json").write_text(json.dumps(settings))
    got = subprocess.run([sys.executable, "-m", "jobs.review_corpus", "--config", str(tmp_path / "config.json"), "--buckets", "2"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert json.loads(got.stdout.splitlines()[-1])["buckets"] == [0, 1] and "it now holds" in got.stderr and "read 200 rows of" in got.stderr
    settings = ["--source", f"{small}/documents.parquet", "--output", str(tmp_path / "t"), "--checkpoint", str(tmp_path / "c"), "--wait-seconds", "0"]
    got = subprocess.run([sys.executable, "-m", "jobs.translate_corpus", *settings], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert json.loads(got.stdout.splitlines()[-1]) == {"batches": 1, "rows": {"translated": 200}} and "read 200 new rows" in got.stderr
    with pytest.raises(ValueError, match="unknown settings"):
        translate_corpus.run(None, {"sauce": 1})


def test_no_job_needs_the_training_data_operators():
    for name in os.listdir(os.path.join(ROOT, "jobs")):
        if name.endswith(".py"):
            text = open(os.path.join(ROOT, "jobs", name)).read()
            assert "llm" not in text and "corpus_pipeline" not in text


def test_one_bad_prompt_costs_few_calls():
    calls = []

    def model(asked):
        calls.append(len(asked))
        if any(p == "bad" for p, _ in asked):
            raise ValueError("refused")
        return [p.upper() for p, _ in asked]

    prompts = [(f"p{i}", None) for i in range(63)] + [("bad", None), (None, None)]
    got = providers.asked_all(model, prompts, attempts=1, batch=64)
    assert got[:63] == [(f"P{i}", None) for i in range(63)] and got[63:] == [(None, "ValueError: refused"), (None, None)]
    assert len(calls) == 1 + 2 * 6 and sum(calls) <= 64 + 2 * 63
    assert providers.asked_all(lambda a: ["only one"], [("a", None), ("b", None)], attempts=1) == [("only one", None), ("only one", None)]


def test_waits_only_after_failed_calls(monkeypatch):
    waits = []
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    providers.asked_all(lambda a: ["no"] * len(a), [("a", None)], wait=2.0, accept=lambda r: r == "yes")
    assert waits == []

    def down(_):
        raise OSError("down")

    assert providers.asked_all(down, [("a", None)], wait=2.0) == [(None, "OSError: down")] and waits == [2.0, 2.0]


def test_stopped_questions_go_on_where_they_were(spark, tmp_path):
    from lathework.plans import corpus

    log, stop = str(tmp_path / "log"), str(tmp_path / "stop")
    open(stop, "w").close()
    good = json.dumps({"long_question": {"question": "l", "answer": "L"}})

    def make(reply):
        def build():
            def model(asked_now):
                if os.path.exists(stop) and any("p5" in p for p, _ in asked_now):
                    raise SystemExit("stopped")
                with open(log, "a") as f:
                    f.writelines(json.dumps(f"{p}|{image}") + "\n" for p, image in asked_now)
                return [reply for _ in asked_now]

            return model

        return build

    rows = spark.createDataFrame([(f"r/Goa/food/{i}.jpg", f"caption p{i % 8}", "u", "success") for i in range(8)], "image_path string, caption string, source_url string, status string")
    work = lambda: corpus.questioned(rows, make(good), make("Adversarial Question: x\nAnswer: y"), store=str(tmp_path / "store"))
    with pytest.raises(Exception):
        work()
    before = asked(log)
    assert 0 < len(before) < 8
    os.remove(stop)
    got = work()
    assert sorted(r.status for r in got.collect()) == ["success"] * 8
    every = asked(log)
    committed = {r.prompt_key for r in spark.read.parquet(str(tmp_path / "store" / "standard")).collect()}
    assert len(committed) == 8 and len(set(every)) == 16 and len(every) <= 16 + 2  # what a stopped part had not committed is asked again
    assert got.count() == work().count() == 8 and asked(log) == every
    captions = lambda: corpus.captioned(spark.createDataFrame([("1.jpg", "u", "food")], "image_filename string, source_url string, category string"), "r", "Goa", lambda df, _: df, make("a meal"), store=str(tmp_path / "captions"))
    assert captions().first().caption == captions().first().caption == "a meal" and len(asked(log)) == len(every) + 1
