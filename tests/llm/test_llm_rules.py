"""Rules of decontamination, secrets and samples that brute force can tell."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import frame, words

from lathework.llm import decontaminate, secrets
from lathework.llm.shared import written

ITEMS = "item_id long, text string"


def holds(item, text):
    """The stated rule in plain Python, over the whole text as one passage."""
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    w, have, q = item.split(), cut(text.split()), decontaminate.question_words(item)
    every = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    parts = [set(every), set(every[: max(1, min(q, len(every)))]), set(every[min(max(0, q - 4), len(every) - 1) :])]
    share, question, answer = (len(p & have) / len(p) for p in parts)
    return min(question, answer) >= 0.8 or share >= 0.8 and min(question, answer) >= 0.4


def test_retrieval_loses_no_passage_that_meets_the_rule(spark):
    """Templated items: common words with some rare ones at the start, the end or spread, of which texts lack some."""
    rng, items = random.Random(1), []
    common = [f"c{i}" for i in range(35)]
    for i in range(60):
        rare = [f"r{i}x{k}" for k in range(5)]
        w = (rare + common, common + rare, common[:15] + rare + common[15:], [x for k in range(5) for x in [*common[7 * k : 7 * k + 7], rare[k]]])[i % 4]
        items.append((i, " ".join(w)))
    rows = []
    for i, text in items:
        w = text.split()
        for cut in (w[5:], w[:35], w[:15] + w[20:], w[:18] + ["z"] + w[19:], w[3:-4], w[:10] + w[14:], [f"y{rng.random()}" if rng.random() < 0.1 else x for x in w], w):
            rows.append((len(rows), " ".join(["a b", *cut, "d e"])))
    want = {(d, i) for d, text in rows for i, item in items if holds(item, text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == want and len(want) > 150


def test_thresholds_bound_all_texts_that_meet_the_rule():
    """No way of taking away shingles leaves less weight than least_score() says."""
    rng = random.Random(2)
    for _ in range(200):
        text = np.array([rng.randint(0, 25) for _ in range(rng.randint(5, 60))], np.uint64)
        terms = np.unique(text)
        weights = np.array([rng.choice([0.1, 1, 10]) for _ in terms])
        all_of = decontaminate.shingles(text)
        lost = int(0.2 * len(set(all_of.tolist())) + 1e-9)
        least = decontaminate.least_score(text, terms, weights, lost)
        distinct = list(dict.fromkeys(all_of.tolist()))
        for _ in range(20):
            start = rng.randint(0, max(0, len(distinct) - lost))
            gone = set(distinct[start : start + lost] if rng.random() < 0.5 else rng.sample(distinct, lost))
            left = {int(x) for k in range(len(all_of)) if int(all_of[k]) not in gone for x in text[k : k + 5]}
            assert weights[[int(t) in left for t in terms]].sum() >= least - 1e-9


@pytest.mark.parametrize("most", [2, 30, 1_000_000])
def test_items_that_share_an_id_or_repeat_are_found_alike(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", most)
    one, two, three = (words(s, 20, 10_000) for s in (1, 2, 3))
    items = spark.createDataFrame([(7, one), (7, two), (7, one), (8, three), (9, one), (None, two), (10, None)], ITEMS)
    rows = [(1, f"x {one} y {two}"), (2, two), (3, three), (4, "none of it"), (4, f"{three} {one}")]
    got = sorted(((r.doc_id, -1 if r.item_id is None else r.item_id) for r in decontaminate.contaminated(frame(spark, rows), items).collect()))
    assert got == [(1, -1), (1, 7), (1, 7), (1, 9), (2, -1), (2, 7), (3, 8), (4, 7), (4, 8), (4, 9)]
    assert sorted(r.text for r in decontaminate.clean(frame(spark, rows), items).collect()) == ["none of it"]


def test_short_items_match_nothing(spark):
    items = spark.createDataFrame([(1, "Yes."), (2, "one two three four"), (3, "one two three four five")], ITEMS)
    rows = [(1, "yes it is"), (2, "one two three four"), (3, "so one two three four five six")]
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), items).collect()] == [(3, 3)]
    assert decontaminate.contaminated(frame(spark, rows), items.filter("item_id < 3")).count() == 0
    assert decontaminate.clean(frame(spark, rows), items.filter("item_id < 3")).count() == 3


def test_tokens_that_no_base_span_overlaps(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        base = sorted((a, a + rng.randint(1, 60)) for a in (rng.randint(0, 2000) for _ in range(rng.randint(0, 150))))
        tokens, at = [], 0
        while at < 2000 * (i % 5 > 0):
            begin = at + rng.randint(1, 20)
            at = begin + rng.randint(1, 30)
            tokens.append((begin, at))
        rows.append((i, [(a, b, "b") for a, b in base], [(a, b, "t") for a, b in tokens]))
    span = "array<struct<start:int,end:int,value:string>>"
    df = spark.createDataFrame(rows, f"i int, base {span}, long {span}")
    for r in df.select("base", "long", secrets._free(F.col("base"), F.col("long")).alias("free")).collect():
        want = [tuple(s) for s in r.long if not any(b.start < s.end and s.start < b.end for b in r.base)]
        assert [tuple(s) for s in r.free] == want


def test_a_text_of_many_matches_takes_no_square(spark):
    text = lambda n: "\n".join(f"token= {'aB3xK9-q' * 4}{i:06d}" for i in range(n))
    took = []
    for n in (4000, 32_000):
        began = time.time()
        got = secrets.digest(secrets.scan(spark.createDataFrame([(1, text(n))], "doc_id long, text string"), [0.0] * (len(secrets.ALPHABET) + 1) ** 2)).first()
        took.append(time.time() - began)
        assert (got.n_assign, got.n_markov) == (n, 0)
    assert took[1] < 20 and took[1] < 8 * max(took[0], 1.5)


@pytest.mark.parametrize("hot, most", [(100_000, 200_000), (3, 200_000), (1, 4)])
def test_url_filter_of_a_hot_domain_long_urls_and_clashing_columns(spark, monkeypatch, hot, most):
    from lathework.llm import url_filter

    monkeypatch.setattr(url_filter, "HOT_ROWS", hot)
    monkeypatch.setattr(url_filter, "MOST_HOT", most)
    long = "x" * 300_000
    rows = [(i, f"https://h{i % 40}.big.org/{i}", f"2024-01-{i % 28 + 1:02d}") for i in range(400)]
    rows += [(500, f"http://{'a.' * 300}big.org/{long}", "2024-01-20"), (501, f"http://{long}.org/", "2024-01-20"), (502, long, "2024-01-20"), (503, None, None)]
    entries = [("big.org", "spam", "add", "2024-01-10"), ("h1.big.org", "adult", "add", "2024-01-05"), ("h1.big.org", "adult", "remove", "2024-01-15")]
    captures = spark.createDataFrame([(*r, None, "y", 7, "z") for r in rows], "capture_id long, url string, fetched string, host string, domain string, n long, key string").repartition(5)
    listed = spark.createDataFrame([(d, c, a, t, "x", 1) for d, c, a, t in entries], "domain string, category string, action string, dated string, host string, deals int").withColumn("dated", F.to_date("dated"))
    want = {}
    for i, url, day in rows:
        host = (url or "").split("//")[-1].split("/")[0] if url and "//" in url else ""
        active = {"spam"} if (host == "big.org" or host.endswith(".big.org")) and day >= "2024-01-10" else set()
        if host == "h1.big.org" and "2024-01-05" <= day < "2024-01-15":
            active.add("adult")
        want[i] = (host, bool(active), len(active), ",".join(sorted(active)))
    got = {r.capture_id: (r.host, r.blocked, r.n_entries, r.categories) for r in url_filter.judged(captures, listed).collect()}
    assert got == want
    pages = spark.createDataFrame([(1, None), (2, "nothing"), (3, "http://a.b.c.org/x"), (4, "http://a.b.c.org/y")], "page_id long, url string")
    once = sorted(map(tuple, url_filter.derived_entries(pages).collect()), key=str)
    assert once == sorted(map(tuple, url_filter.derived_entries(pages.filter("page_id <> 4")).collect()), key=str)
    assert url_filter.derived_entries(pages.limit(0)).count() == url_filter.derived_entries(pages.filter("page_id < 3")).count() == 0


def test_token_files_of_null_ids_on_several_partitions(spark):
    import public_tokenizers

    from lathework.llm import simple8b

    rows = [(None, f"text {i} {words(i, 30)}") for i in range(40)] + [(i, None) for i in range(5)] + [(3, words(3, 900))] * 3
    files = simple8b.write_files(frame(spark, rows).repartition(6), public_tokenizers.path("word_bpe_49k.json"), end_id=1, record_ids=200)
    got = simple8b.read_files(files).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted((-1 if d is None else d) for d, _ in rows)
    spans = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got)
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans[:-1], spans[1:], strict=True)) and spans[0][0] == 0
    assert len({r.ids_crc32 for r in got if r.doc_id == 3}) == 2


def test_jaccard_join_is_the_same_with_counts_of_a_share(spark, monkeypatch):
    from test_llm_operators import brute_components

    from lathework.llm import jaccard_join

    rows = [(i, words(i % 40, 60, 3000) + f" tail{i % 7}") for i in range(160)] + [(200 + i, words(5, 40)) for i in range(5)]
    stored = written(jaccard_join._keyed(frame(spark, rows)), "few")
    monkeypatch.setattr(jaccard_join, "COUNTED_BYTES", 100)
    assert jaccard_join.sketch_bits(stored)[1] > 1
    monkeypatch.setattr(jaccard_join, "sketch_bits", lambda docs: (16, 5))
    got = jaccard_join.join(frame(spark, rows), words=3, percent=60).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 3, 60)


def test_sketch_counts_the_shingles_of_all_texts_whatever_the_size(spark, monkeypatch):
    from lathework.llm import jaccard_join

    rows = [(i, words(i % 40, 60, 3000) + f" tail{i % 7}") for i in range(160)] + [(300, None), (301, "")] + [(400 + i, "the same three words again") for i in range(300)]
    monkeypatch.setattr(jaccard_join, "COUNTED_BYTES", 100)
    stored = written(jaccard_join._keyed(frame(spark, rows)).repartition(5), "all")
    assert jaccard_join.sketch_bits(stored)[1] > 1
    surveyed, sketch, _ = jaccard_join.survey(stored, 3)
    assert sketch.sum() == surveyed.agg({"n": "sum"}).first()[0] and sketch.max() >= 300
