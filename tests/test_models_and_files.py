"""Images at the models, models asked once, CSV folders by name, draws by threshold."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lathework import providers
from lathework.operators import lookups, sampling
from lathework.plans import corpus, evaluate, generate
from lathework.sources import readers


def seen(log):
    """A maker of a provider that writes down what it is asked about which image."""

    def make():
        def reply(asked):
            with open(log, "a") as f:
                f.writelines(json.dumps([p, image]) + "\n" for p, image in asked)
            return [f"{len(p)}|{image}" for p, image in asked]

        return reply

    return make


def asked(log):
    return [tuple(json.loads(x)) for x in open(log)]


def samples(spark, n=6):
    names = [*generate.QUESTIONS, *generate.QUESTIONS.values(), *generate.OPTIONS]
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("Hindi").alias("language"), F.lit("s").alias("State/UT"), F.lit("t").alias("topic"), F.lit("u").alias("source_url"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("image"), *(F.concat(F.lit(f"{x} "), F.col("id").cast("string")).alias(x) for x in names))


def test_every_prompt_goes_with_its_image(spark, tmp_path):
    log = str(tmp_path / "vqa")
    got = generate.vqa(samples(spark), "m", seen(log)).collect()
    assert all(v.endswith(f"|i{r.id}") for r in got for v in r.predictions) and len(asked(log)) == 36
    pages = samples(spark).withColumns({"page_url": F.lit("p"), "text": F.lit("x")})
    assert {r.predicted_text.split("|")[1] for r in generate.ocr(pages, "m", seen(str(tmp_path / "ocr"))).collect()} == {f"i{i}" for i in range(6)}
    assert {r.predicted_text.split("|")[1] for r in generate.ocr(pages.drop("image"), "m", seen(str(tmp_path / "ocr"))).collect()} == {"None"}
    wide = samples(spark).withColumns({"English": F.col("short_q1"), "Hindi": F.lit("h"), "Tamil": F.lit("t")})
    got = generate.mmt(wide, "m", seen(str(tmp_path / "mmt")), languages=("Hindi", "Tamil")).collect()
    assert len(got) == 12 and all(r.predicted_caption.endswith(f"|i{r.id}") for r in got)


def test_questions_name_file_and_category(spark, tmp_path):
    log = str(tmp_path / "qa")
    good = json.dumps({"long_question": {"question": "l", "answer": "L"}})

    def make(inner=seen(log)):
        note = inner()
        return lambda x: [good for _ in note(x)]

    rows = spark.createDataFrame([("r/Goa/food/7.png", "a meal", "u", "success")], "image_path string, caption string, source_url string, status string")
    corpus.questioned(rows, make, make, attempts=1).collect()
    (standard, image), (adversarial, again) = asked(log)
    assert image == again == "r/Goa/food/7.png"
    assert standard.split("\n")[1:] == ["File: 7.png", "Category: food", "a meal"] and adversarial.split("\n")[1:] == ["Category: food", "a meal"]


def test_reports_ask_the_model_once(spark, tmp_path):
    for name, task in (("s", evaluate.structured), ("o", evaluate.open_ended)):
        log = str(tmp_path / name)
        report = task(generate.vqa(samples(spark), "m", seen(log)))
        rows = {r.scope: r for r in report.collect()}
        assert rows["overall"].total_data_points == 6
        assert len(asked(log)) == len(set(asked(log))) == 36


# ---------------------------------------------------------------- files


def test_csv_folder_of_differing_headers(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "Goa.csv").write_text('image_path,caption,n\na/1,"two\nlines, ""quoted""",1\n')
    (folder / "Tamil Nadu.csv").write_text("n,image_path,more,caption\n2,a/2,x,c2\n3,a/3,,c3\n")
    (folder / "Punjab+.csv").write_text("image_path\na/4\n")
    (folder / "Bihar.csv").write_text("caption,image_path,n\n")
    (folder / "empty.csv").write_text("")
    path = str(folder)
    want = {("a/1", 'two\nlines, "quoted"', 1, None), ("a/2", "c2", 2, "x"), ("a/3", "c3", 3, None), ("a/4", None, None, None)}
    got = readers.csv_by_name(spark, path, "image_path string, caption string, n int, more string, absent date")
    assert got.columns == ["image_path", "caption", "n", "more", "absent"] and {tuple(r)[:4] for r in got.collect()} == want
    free = readers.csv_by_name(spark, path)
    assert {(r.image_path, r.caption, r.n, r.more) for r in free.collect()} == want and dict(free.dtypes)["n"] == "int"
    states = {r.image_path: r.state for r in readers.csv_by_state(spark, path, "image_path string").collect()}
    assert states["a/1"] == "Goa" and states["a/2"] == "Tamil Nadu"
    with pytest.raises(Exception):  # one scan would put values under wrong names
        readers.csv(spark, path, "image_path string, caption string, n int").collect()


def test_csv_types_that_fit_all_files(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b,c\n1,2,x\n")
    (tmp_path / "2.csv").write_text("c,b,a\n7,2.5,no\n")
    got = readers.csv_by_name(spark, str(tmp_path))
    assert dict(got.dtypes) == {"a": "string", "b": "double", "c": "string"}
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == [("1", 2.0, "x"), ("no", 2.5, "7")]
    (tmp_path / "3.csv").write_text("a,a,b\n5,6,1\n")
    assert {r.a for r in readers.csv_by_name(spark, str(tmp_path), "a string, b double").collect()} == {"1", "no", "5"}
    (tmp_path / "none").mkdir()
    assert readers.csv_by_name(spark, str(tmp_path / "none"), "a string").collect() == []
    for name in ("1_corrected.csv", "2_corrected.csv"):
        os.rename(tmp_path / name.replace("_corrected", ""), tmp_path / name)
    assert sorted((r.a, r.language) for r in readers.csv_by_language(spark, str(tmp_path), schema="a string").collect()) == [("1", "1"), ("no", "2")]


# ---------------------------------------------------------------- draws and upserts


@pytest.mark.parametrize("most", [0, 1, 7, 250, 499, 500, 5000])
def test_draws_are_those_of_a_full_sort(spark, monkeypatch, most):
    monkeypatch.setattr(sampling, "DIGITS", 1)  # many rows share the border's digits
    rows = spark.range(500).withColumn("x", F.lit("wide"))
    got = sorted(r.id for r in sampling.drawn(rows, "id", most, seed=3).collect())
    want = rows.orderBy(sampling.draw(F.col("id"), 3), "id").limit(most)
    assert got == sorted(r.id for r in want.collect())


def test_a_draw_sorts_no_wide_rows_and_takes_repeats(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.lit("wide").alias("x"))
    got = sampling.drawn(rows, "k", 150)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    counts = sorted(r["count"] for r in got.groupBy("k").count().collect())
    assert counts == [50, 100]


def test_upsert_splits_hot_keys_and_keeps_null_ones(spark):
    base = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), (None, "4"), ("b", "5")], "k string, x string")
    changes = spark.createDataFrame([("a", 1, "n"), (None, 1, "z"), ("c", 1, None), ("c", 2, " ")], "k string, s int, x string")
    got = lookups.upserted(base, changes, "k", "s")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "n"), ("a", "n"), (None, "3"), (None, "4"), ("b", "5"), (None, "z"), ("c", " ")], key=str)
    assert "FullOuter" not in got._jdf.queryExecution().executedPlan().toString()
    assert providers.maker("stub-seeing")()([("p", None), ("p", "i")])[0] != providers.maker("stub-seeing")()([("p", "i")])[0]


# ---------------------------------------------------------------- images, copies, pages


def test_sizes_of_images(spark):
    from lathework.functions.images import image_format, image_size, too_large

    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A0000000D49484452") + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"rest"
    frame = lambda w, h, m=0xC0: bytes([0xFF, m, 0, 17, 8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\3"
    app = bytes.fromhex("FFE1") + (40_000).to_bytes(2, "big") + b"\xff\xc0" * 19_999
    rows = [png(5, 70_000), png(1080, 1080), b"\xff\xd8" + frame(1081, 3), b"\xff\xd8" + app + b"\xff\xff" + frame(7, 8, 0xC2)[0:], b"\xff\xd8" + app, b"\xff\xd8\xff\xda\0\2", b"\xff\xd8\xff", b"GIF89a", b"", None, png(1, 2)[:19], b"\xff\xd8\x00" + frame(1, 1)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(rows)], "i int, content binary")
    got = sorted(df.select("i", image_format(F.col("content")).alias("f"), image_size(F.col("content")).alias("s"), too_large(F.col("content")).alias("large")).collect())
    assert [r.f for r in got] == ["png", "png", *["jpeg"] * 5, None, None, None, "png", "jpeg"]
    assert [None if r.s is None else tuple(r.s) for r in got] == [(5, 70_000), (1080, 1080), (1081, 3), (7, 8), *[None] * 8]
    assert [r.large for r in got] == [True, False, True] + [False] * 9


def test_copies_are_whole_and_failures_drop(spark, tmp_path):
    from lathework.sources import writers

    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i} é.jpg").write_bytes(bytes([i]) * 3_000_000)
    rows = [(i, str(tmp_path / "in" / f"{i} é.jpg"), "hi" if i % 2 else "ta") for i in range(5)] + [(9, None, "hi")]
    df = spark.createDataFrame(rows, "id int, image_path string, lang string").withColumn("from", F.col("image_path")).repartition(3)
    df = df.unionAll(df.filter("id = 1"))  # two tasks copy one file
    moved = writers.language_paths(df, str(tmp_path / "out"))
    for _ in range(2):
        got = writers.copied(moved, "from", "image_path").collect()
        assert sorted(r.id for r in got) == [0, 1, 1, 2, 3]
        assert sorted(os.listdir(tmp_path / "out" / "hi")) == ["1 é.jpg", "3 é.jpg"] and sorted(os.listdir(tmp_path / "out" / "ta")) == ["0 é.jpg", "2 é.jpg"]
    assert all((tmp_path / "out" / r.lang / f"{r.id} é.jpg").read_bytes() == bytes([r.id]) * 3_000_000 for r in got)
    errors = {r.id: r.why for r in writers.copied(moved, "from", "image_path", "why").collect()}
    assert errors[0] is None and "FileNotFound" in errors[4] and errors[9] == "no path"


def test_hosts_get_a_bounded_number_of_calls_at_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fetch(urls):
        import time as clock

        began = clock.time()
        clock.sleep(0.02)
        with open(log, "a") as f:
            f.write(json.dumps([urls[0].split("/")[2], began, clock.time()]) + "\n")
        if urls[0].endswith("bad"):
            raise OSError("down")
        return [("page " + urls[0], None)] if not urls[0].endswith("404") else [(None, "404")]

    hot = [f"https://hot.example/{i}" for i in range(60)]
    rows = [(u,) for u in [*hot, "https://a.example/bad", "https://b.example/404", *(f"https://h{i}.example/x" for i in range(20)), None]]
    got = {r.url: (r.html, r.error) for r in readers.fetched(spark.createDataFrame(rows, "url string").repartition(7), fetch, attempts=2, per_host=2, pause=0.001, wait=0.01).collect()}
    assert got["https://a.example/bad"] == (None, "OSError: down") and got["https://b.example/404"] == (None, "404") and got[None][0] is None
    assert all(got[u] == (f"page {u}", None) for u in hot)
    calls = [json.loads(x) for x in open(log)]
    assert sum(c[0] == "a.example" for c in calls) == 2 and sum(c[0] == "hot.example" for c in calls) == 60
    for _, begin, end in (c for c in calls if c[0] == "hot.example"):
        assert sum(b < end and begin < e for h, b, e in calls if h == "hot.example") <= 5  # at most two at any one time
    times = sorted([(b, 1) for h, b, _ in calls if h == "hot.example"] + [(e, -1) for h, _, e in calls if h == "hot.example"])
    now = most = 0
    for _, d in times:
        now += d
        most = max(most, now)
    assert most <= 2


def test_pages_are_parsed_once_with_the_same_parts(spark):
    from lathework.functions.html import element_text, image_url, page_parts, proofread

    page = '<p class="prp-page-qualityheader quality4"></p><div class="prp-page-image"><span><img src="//x/1"></span></div><div class="pagetext"> a <b>b</b></div>'
    rows = spark.createDataFrame([(page,), (page.replace("quality4", "quality3"),), (page.replace("<img", "<i"),), (None,), ("",), (page.replace("pagetext", "p"),)], "html string")
    html = F.col("html")
    for r in rows.select(page_parts(html).alias("p"), proofread(html).alias("good"), image_url(html).alias("image"), element_text(class_name="pagetext")(html).alias("text")).collect():
        assert r.p.proofread == r.good and r.p.image == (r.image if r.good else None) and r.p.text == (r.text if r.good and r.image else None)
