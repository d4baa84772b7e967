import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lathework.functions import bleu, edit, html, normalize, replies, ribes, text


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("ref", "hyp", "word", "char"),
    [
        ("the cat sat", "the bat sat", 33.3333, 9.0909),
        ("a b c", "a c", 33.3333, 40.0),
        ("kitten", "sitting", 100.0, 42.8571),
        ("नमस्ते भारत", "नमस्ते भारतीय", 50.0, 15.3846),
        ("abc", "", 100.0, 100.0),
        ("", "", math.inf, math.inf),
    ],
)
def test_ocr_scores(spark, ref, hyp, word, char):
    df = spark.createDataFrame([(ref, hyp)], "r string, h string")
    got = edit.with_ocr_scores(df, F.col("r"), F.col("h")).first()
    assert (got.anls_word, got.anls_char) == (word, char)


@pytest.mark.parametrize(
    ("ref", "hyp", "score"),
    [
        ("a b c d", "a b c d", 1.0),
        ("a b c d", "d c b a", 0.0),
        ("a b c d", "a c b d", 0.8333333333333334),
        ("a b c d", "a b", 0.9048374180359595),
        ("a", "a b", 0.8408964152537145),
        ("a a", "a a", 1.0),
        ("the cat the dog", "the dog the cat", 0.3333333333333333),
        ("a b", "c d", 0.0),
        ("x", "", 0.0),
        ("", "x", None),
    ],
)
def test_ribes(ref, hyp, score):
    assert ribes.ribes(ref, hyp) == (None if score is None else pytest.approx(score, abs=1e-9))


@pytest.mark.parametrize(
    ("ref", "hyp", "score"),
    [
        ("the cat sat on a mat", "the cat sat on the mat", 53.7284965911771),
        ("a b c d", "a b c d", 100),
        ("a b c", "a b c", 0),
        ("a b c d e f", "a b c d", 60.653065971263366),
        ("a b c d", "a x c y", 18.99589214128981),
        ("a b c d", "w x y z", 0),
    ],
)
def test_bleu(ref, hyp, score):
    assert bleu.bleu(ref, hyp) == pytest.approx(score, abs=1e-9)


def test_ranges_of_random_texts():
    rng = random.Random(7)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert 0 <= ribes.ribes(a, b) <= 1
        assert 0 <= bleu.bleu(a, b) <= 100 + 1e-9


@pytest.mark.parametrize(
    ("language", "given", "want"),
    [
        ("English", "<B>", "B"),
        ("English", "c.", "C"),
        ("English", ". B", "B"),
        ("English", "A traditional dance", "A"),
        ("English", "B) x", "B) x"),
        ("English", "(A)", "(A)"),
        ("English", "A\nbecause", "A\nbecause"),
        ("Hindi", "<अ>", "A"),
        ("Tamil", "C.", "C"),
        ("English", "  ", ""),
        ("Nowhere", "b", "B"),
        ("English", None, ""),
    ],
)
def test_option_letter(spark, language, given, want):
    assert one(spark, [(given, language)], "v string, l string", normalize.option_letter(F.col("v"), F.col("l"))) == [want]


@pytest.mark.parametrize(("language", "given", "want"), [("English", "true.", "true"), ("English", "<True>", "<True>"), ("Marathi", "चुकीचे", "चूक"), ("Hindi", "सही।", "सही"), ("Hindi", None, "")])
def test_true_false(spark, language, given, want):
    assert one(spark, [(given, language)], "v string, l string", normalize.true_false(F.col("v"), F.col("l"))) == [want]


def test_judge_score(spark):
    given = ["7", " 7.5\n", "12", "-3", "seven", "7d", "", None, "nan", "७", "1e1", ".5"]
    assert one(spark, [(g,) for g in given], "v string", normalize.judge_score(F.col("v"))) == [7.0, 7.5, 10.0, 0.0, None, None, None, None, None, 7.0, 10.0, 0.5]


def test_rounding_is_pythons(spark):
    rng = random.Random(3)
    values = [0.0625, 0.5, 2.675, 1e-9, 33.333333] + [rng.uniform(0, 100) for _ in range(500)] + [k / 80 for k in range(300)]
    assert one(spark, [(v,) for v in values], "v double", text.rounded(F.col("v"), 3)) == [round(v, 3) for v in values]
    assert one(spark, [(math.inf,), (None,)], "v double", text.rounded(F.col("v"), 3)) == [math.inf, None]


def test_white_space_is_pythons(spark):
    marks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [f"{m}a{m}{m}b c{m}" for m in marks] + ["", " ", "x"]
    assert one(spark, [(r,) for r in rows], "v string", text.tokens(F.col("v"))) == [r.split() for r in rows]
    assert one(spark, [(r,) for r in rows], "v string", text.strip(F.col("v"))) == [r.strip() for r in rows]


def test_quoted_titles(spark):
    from urllib.parse import quote

    rows = ["A b/c", "é~x*y", "a+b&c?d=e#f", "(x)'!", 'q"%']
    assert one(spark, [(r,) for r in rows], "v string", text.quote_title(F.col("v"))) == [quote(r.replace(" ", "_")) for r in rows]


def test_replies(spark):
    good = '{"short_questions":[{"question":"q","answer":"a"}],"multiple_choice_questions":[{"question":"m","answer":"B","options":{"D":"1","A":"2"}}],"true_false_question":{"question":"t","answer":"True"},"long_question":{"question":"l","answer":"L"}}'
    rows = [good, f"```json\n{good}\n```", f"```{good}```", f"\n```json{good}", "no", None]
    fields = replies.qa_fields(F.col("v"))
    for name, want in (("short_q1", "q"), ("short_q2", ""), ("mc_opt1_1", "1"), ("mc_opt1_2", "2"), ("mc_opt1_3", ""), ("long_a", "L")):
        assert one(spark, [(r,) for r in rows], "v string", fields[name]) == [want] * 3 + [None] * 3
    said = ["Adversarial Question: x\nAnswer: y", "Answer: y", "Adversarial Question: a\nAdversarial Question: b\nAnswer: c"]
    got = one(spark, [(r,) for r in said], "v string", replies.line_fields(F.col("v")))
    assert [tuple(g) for g in got] == [("x", "y"), (None, None), ("b", "c")]


def test_html(spark):
    page = '<div class="x prp-page-qualityheader quality4">q</div><div class="pagetext"> a <p>b<br>c</p> d</div><div class="pagetext">no</div><div class="prp-page-image"><span><a><img alt="" src="//h/i.jpg"></a></span></div>'
    rows = [page, page.replace("quality4", "quality3"), "<p>x</p>", None]
    assert one(spark, [(r,) for r in rows], "v string", html.proofread(F.col("v"))) == [True, False, False, False]
    assert one(spark, [(r,) for r in rows], "v string", html.element_text("pagetext")(F.col("v"))) == ["a\nb\nc\nd"] * 2 + [None] * 2
    assert one(spark, [(r,) for r in rows], "v string", html.image_url(F.col("v"))) == ["https://h/i.jpg"] * 2 + [None] * 2


@pytest.mark.parametrize(
    ("page", "good", "image"),
    [
        ('<p class="prp-page-qualityheader-note quality4">', False, None),
        ('<p data-class="prp-page-qualityheader quality4">', False, None),
        ('<p class="prp-page-qualityheader quality3 quality4 qualityx">', True, None),
        ('<p class=\'a prp-page-qualityheader\'></p><p class="prp-page-qualityheader quality4">', False, None),
        ('<!-- <p class="prp-page-qualityheader quality4"> --><div class="prp-page-image"></div><span><img src="//x"></span>', False, None),
        ('<div class="prp-page-image"><b><span><i></i></span><span><img src="//y"></span></b></div>', False, None),
        ('<div title="a>b" class="prp-page-image"><br><span><a><img alt="x>y" src="//z?a=1&amp;b"/></a></span></div>', False, "https://z?a=1&b"),
        ('<div class="prp-page-image-note"><span><img src="//n"></span></div>', False, None),
        ('<div class="prp-page-image"><span><img alt="q"></span></div>', False, None),
    ],
)
def test_odd_pages(page, good, image):
    assert (4 in html.levels(page, "prp-page-qualityheader")) == good
    source = html.image_source(page, "prp-page-image")
    assert (None if source is None else f"https:{source}") == image


def test_alignment_against_its_definition():
    def times(words, run):
        return sum(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1))

    def slowly(ref, hyp):
        out = []
        for i, word in enumerate(hyp):
            if word not in ref:
                continue
            for size in range(max(i + 1, len(hyp) - i + 1)):
                runs = [(hyp[i - size : i + 1], size)] * (size <= i) + [(hyp[i : i + size + 1], 0)] * (i + size < len(hyp))
                found = [(run, back) for run, back in runs if times(ref, run) == 1 and times(hyp, run) == 1]
                if found:
                    run, back = found[0]
                    out.append(next(k for k in range(len(ref)) if ref[k : k + len(run)] == run) + back)
                    break
        return out

    rng = random.Random(4)
    for _ in range(1500):
        a, b = ([rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(1, 14))] for _ in range(2))
        b = a[:] if rng.random() < 0.3 else b
        assert ribes.aligned(a, b) == slowly(a, b), (a, b)


def test_distances_beyond_each_threshold(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abc") for _ in range(n)), "".join(rng.choice("abc") for _ in range(n + 40))) for n in (5, 100, 400)]
    rows += [("a" * 2000, "b" * 1500), ("x" * 70, "x" * 70), ("", "")]

    def slowly(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    assert one(spark, rows, "a string, b string", edit.distance(F.col("a"), F.col("b"))) == [slowly(a, b) for a, b in rows]


def slowly_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("block", [1, 3, 8, 64, 8192])
def test_bit_parallel_distance_in_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(edit, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        a, b = ("".join(rng.choice("abकक्😀𝒳") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert edit.bit_parallel(a, b) == slowly_apart(a, b), (a, b)
        assert edit.bit_parallel(a.split("a"), b.split("a")) == slowly_apart(a.split("a"), b.split("a"))


def test_bit_parallel_distance_of_long_texts_is_fast():
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdefghij") for _ in range(20_000)) for _ in range(2))
    began = time.time()
    got = edit.bit_parallel(a, b)
    assert time.time() - began < 5 and edit.bit_parallel(b, a) == got
    assert edit.bit_parallel(a, a[:9000] + "zz" + a[9001:]) == 2 and edit.bit_parallel("", a) == 20_000


def test_ocr_scores_of_long_and_very_different_texts(spark):
    """Beyond all thresholds the scores are those of the whole table."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)), " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))) for n in (50, 3000)]
    rows += [("ab " * 3000, "ab " * 2999 + "c"), ("x" * 7000, "y" * 6500)]
    df = spark.createDataFrame(rows, "r string, h string")
    got = edit.with_ocr_scores(df, F.col("r"), F.col("h")).select("anls_word", "anls_char", F.levenshtein(F.trim("r"), F.trim("h")).alias("d"), F.greatest(F.length(F.trim("r")), F.length(F.trim("h"))).alias("n")).collect()
    for r, (a, b) in zip(got, rows, strict=True):
        assert r.anls_char == round(r.d * 100 / r.n, 4)
        assert r.anls_word == round(edit.bit_parallel(a.split(), b.split()) * 100 / max(len(a.split()), len(b.split())), 4)


def test_judge_scores_are_pythons_numbers(spark):
    given = ["inf", "-Infinity", "+INF", "1_0", "1__0", "_1", "1_", "0_1.5_0e0_1", "infinit", "nan", "5.", "."]

    def python(text):
        try:
            return None if text == "nan" else min(max(float(text), 0.0), 10.0)
        except ValueError:
            return None

    assert one(spark, [(g,) for g in given], "v string", normalize.judge_score(F.col("v"))) == [python(g) for g in given]
    assert [normalize.is_judge_score(g) for g in given] == [python(g) is not None for g in given]


def test_word_distance_of_few_and_many_distinct_tokens(spark):
    """Pairs whose tokens are looked up in one list, and in groups."""
    rng = random.Random(9)
    sides = [([f"w{rng.randrange(k)}" for _ in range(n)], [f"w{rng.randrange(k)}" for _ in range(n + 5)]) for k, n in ((3, 20), (edit.FEW // 2, 300), (9 * edit.FEW, 900))] + [([], ["a"]), ([], [])]
    df = spark.createDataFrame(sides, "r array<string>, h array<string>").withColumn("v", edit.vocabulary_of(F.col("r"), F.col("h")))
    got = df.select(F.size("v").alias("groups"), edit.token_distance(F.col("r"), F.col("h"), F.col("v")).alias("d")).collect()
    assert [r.d for r in got] == [edit.bit_parallel(a, b) for a, b in sides]
    assert [r.groups for r in got] == [1, 1, edit.GROUPS, 1, 1]


def test_a_reply_is_made_once(spark):
    """Its expression occurs once in a field's, so what makes it isn't run again for each use."""
    made = replies.qa_fields(F.concat(F.col("v"), F.lit("made-here")))["mc_q1"]
    assert str(made).count("made-here") == 1
