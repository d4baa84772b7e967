"""Each operator on odd rows (nulls, empty and long texts, repeats, ties, clashing columns, no rows) and against brute force."""

import functools
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import components, decontaminate, exact_dedup, jaccard_join, language_id, packing, quality, secrets, shared, simple8b, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, label string, a string, class string, text_sha256 string, score string, n string, size string"


def frame(spark, rows):
    """rows: (doc_id, text); the other columns clash with the operators' own names and are null in part."""
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None, "x", None, "y", "z", None, "s", "n", None) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def words(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


BASE = words(1, 60)
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, BASE), (5, BASE), (5, BASE), (6, BASE + " tail"), (7, BASE.upper()), (8, "one"), (9, "one"), (10, "One two"),
    (11, words(2, 30_000, 5000)), (12, words(3, 200)), (12, words(4, 50)), (None, BASE), (None, None), (13, "é ß Σ x <|endoftext|> it's  a\r\n b"), (14, "word, " * 3),
]


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, k, percent):
    rows = list(ODD)
    rng = random.Random(5)
    for g in range(6):  # groups of near copies, chains and hot shared passages
        base = words(100 + g, rng.randint(8, 120))
        for c in range(rng.randint(2, 25)):
            w = base.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
            rows.append((1000 * g + 100 + c, " ".join(w)))
    rows += [(9000 + i, BASE + " " + words(500 + i, 3 + i)) for i in range(20)]
    got = jaccard_join.join(frame(spark, rows), k, percent)
    assert Counter(map(tuple, got.collect())) == brute_components(rows, k, percent)


def near_groups(seed):
    """Groups of near copies, chains and a hot shared passage; some ids have several texts, some rows none."""
    rng, rows = random.Random(seed), []
    for g in range(5):
        base = words(1000 * seed + g, rng.randint(8, 80))
        for c in range(rng.randint(2, 15)):
            w = base.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
            rows.append((rng.choice([None, *range(40)]), " ".join(w)))
    return rows + [(rng.randint(0, 60), BASE + " " + words(500 + i, 3 + i)) for i in range(12)]


A, B = words(71, 99), words(72, 99)


def repeated_ids():
    """Cases of their own, each with its ids and texts: a doc_id with several texts that are copies, near copies or neither."""
    cases = [
        lambda a, b: [(1, a), (5, a), (5, b), (9, b + " tail")],
        lambda a, b: [(5, a), (5, b), (9, b + " tail")],
        lambda a, b: [(1, a), (5, a + " tail"), (5, b)],
        lambda a, b: [(1, a), (None, a + " t1"), (2, a + " t1 t2"), (3, a + " t1 t2 t3")],
        lambda a, b: [(None, a), (None, a), (None, a + " tail"), (4, b), (4, b)],
    ]
    return [(None if d is None else 100 * k + d, t) for k, case in enumerate(cases) for d, t in case(words(170 + k, 99), words(270 + k, 99))]


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_ids_lose_no_link(spark, parts):
    rows = repeated_ids()
    docs = frame(spark, rows).repartition(parts)
    assert Counter(map(tuple, jaccard_join.join(docs, 3, 90).collect())) == brute_components(rows, 3, 90)


def test_jaccard_join_alike_beyond_its_bounds(spark, monkeypatch):
    """Signatures that collide, hot tokens, key tables too large to broadcast, hubs, lists all joined by sizes and a sketch without use."""
    rows = near_groups(1) + repeated_ids()
    want = brute_components(rows, 3, 80)
    for name, value in (("CLASS_BITS", 3), ("HOT", 2), ("SKETCH_BITS", (4, 4)), ("PARTNERS", 2), ("FAN_IN", 2), ("WHOLE_LIST", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(components, "HUB", 1)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, jaccard_join.join(frame(spark, rows), 3, 80).collect())) == want


def test_templated_pages_do_not_all_meet(spark, monkeypatch):
    """Pages of one template with words of their own, too many to link: they share prefix tokens, yet the join makes no square of them."""
    template = words(900, 94, 100_000)
    rows = [(i, f"{template} " + " ".join(f"own{i}x{k}" for k in range(9 + i % 2))) for i in range(300)]
    other = words(901, 94, 100_000)
    rows += [(1000 + i, f"{other} own{i} more{i}") for i in range(12)]  # these link with each other
    met, original = [], jaccard_join.candidates

    def counted(entries, percent):
        wanted, sized = jaccard_join.by_sizes_wanted(entries.filter("outside"), percent), jaccard_join.by_size(entries, percent)
        met.append((entries.filter("outside").select("token", "class").join(entries.select("token", "n"), "token").count(), wanted.select("token", "range").join(sized.select("token", "range"), ["token", "range"]).count()))
        return original(entries, percent)

    monkeypatch.setattr(jaccard_join, "candidates", counted)
    assert Counter(map(tuple, jaccard_join.join(frame(spark, rows), 3, 90).collect())) == brute_components(rows, 3, 90)
    assert met[0][0] > 300 * 300
    assert met[0][1] < 10 * len(rows)


@pytest.mark.parametrize("few", [True, False])
def test_one_document_of_each_component_stays(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    docs = frame(spark, [(1, A), (5, A + " tail"), (5, B), (None, B + " tail"), (7, None), (7, ""), (8, "one"), (9, "one"), (9, "two")]).withColumn("_gone_id", F.lit(1)).withColumn("_gone_key", F.lit(2))
    got = jaccard_join.distinct(docs, 5, 80)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, A), (5, B), (7, None), (7, ""), (8, "one"), (9, "two")])
    assert jaccard_join.distinct(docs.limit(0)).count() == 0


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(frame(spark, ODD).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.labels(links)
    assert got.count() == 299 and {r.label for r in got.collect()} == {1}


def decided(rows):
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    want = Counter()
    for d, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want[(d, keep, len(by[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return want


def test_exact_dedup(spark):
    assert Counter(map(tuple, exact_dedup.decisions(frame(spark, ODD)).collect())) == decided(ODD)
    assert exact_dedup.decisions(frame(spark, ODD).limit(0)).count() == 0
    assert exact_dedup.deduplicated(frame(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_deduplicated_keeps_one_row_of_each_text(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    docs = frame(spark, ODD)
    for c in ("_k", "_keep", "_r", "_digest", "_row", "_size", "head", "_head", "bits", "bucket", "x.y"):
        docs = docs.withColumn(c, F.lit("c"))
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    assert Counter(r.text or "" for r in got.collect()) == Counter({t or "" for _, t in ODD})
    assert {r.doc_id for r in got.filter(F.col("text") == BASE).collect()} == {5}
    assert Counter(map(tuple, exact_dedup.decisions(docs).collect())) == decided(ODD)


def test_full_texts_are_hashed_for_survivors_alone(spark):
    rows = [(i, "x" * i) for i in range(50)] + [(60, "y" * 70 + "a"), (61, "y" * 70 + "b"), (62, "z" * 71), (63, "z" * 71)]
    assert {r.doc_id for r in exact_dedup._survivors(frame(spark, rows), 64)(True).collect()} == {60, 61, 62, 63}
    assert [(r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect()] == [(63, 2)]


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def reference_ids(name, text, end):
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [0], np.zeros(9000), rng.integers(0, 50_000, 20_000), np.minimum(rng.zipf(1.3, 20_000), 49_407), [2**60 - 1, 0, 2**33, *[1] * 500], rng.integers(0, 2, 5000)):
        ids = np.asarray(ids, np.uint64)
        for block in (1, 240, 4096):
            assert (simple8b.decode(simple8b.encode(ids, block)) == ids).all()
    with pytest.raises(ValueError, match="60 bits"):
        simple8b.encode(np.array([2**60], np.uint64))


def test_token_files(spark):
    name = "word_bpe_49k.json"
    got = [tuple(r) for r in simple8b.read_files(simple8b.write_files(frame(spark, ODD), vocabulary(name), record_ids=500)).collect()]
    order = sorted(ODD, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want, start = [], 0
    for d, t in order:
        ids = reference_ids(name, t, 1)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert simple8b.read_files(simple8b.write_files(frame(spark, ODD).limit(0), vocabulary(name))).count() == 0


def test_packing(spark):
    name = "byte_bpe_50k.json"
    got = packing.pack(frame(spark, ODD), vocabulary(name)).collect()
    ids = {}
    for d, t in ODD:
        ids.setdefault(d, []).append(reference_ids(name, t, 0))
    want = Counter((d, s, min(1024, len(x) - s), zlib.crc32(x[s : s + 1024].tobytes()), len(x)) for d, xs in ids.items() for x in xs for s in range(0, len(x), 1024))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024 and sorted(at) == list(range(len(at)))
    assert packing.pack(frame(spark, ODD).limit(0), vocabulary(name)).count() == 0


def test_strategy_takes_every_piece_once():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {rng.randint(1, 1024): rng.randint(1, 5000) for _ in range(rng.randint(1, 200))}
        patterns = packing.strategy(histogram)
        used = Counter()
        for count, lengths in patterns:
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] += count
        assert used == histogram


def test_strategy_takes_a_length_as_often_as_it_fits():
    rng = random.Random(3)
    for histogram in ({600: 1000, 100: 10_000}, {k: 32 for k in range(400, 1025)} | {40: 60_000}, {rng.randint(1, 1024): rng.randint(1, 300) for _ in range(80)}):
        rooms = []  # most room first, one piece after the other
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                if rooms and -rooms[0] >= length:
                    heapq.heapreplace(rooms, rooms[0] + length)
                else:
                    heapq.heappush(rooms, length - 1024)
        patterns = packing.strategy(histogram)
        assert sum(count for count, _ in patterns) == len(rooms)
        assert sorted(1024 - sum(x) for count, x in patterns for _ in range(count)) == sorted(-r for r in rooms)


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark):
    h = hashlib.sha256(b"1").hexdigest()
    rows = [*ODD, (20, f"é😀 password = '{h}' token:short api_key=12345678 APIKEY: abcdefgh"), (21, f"AKIA{'A' * 12} AKIAKIA {h}{h} {h[:31]}"), (22, "secret=secret=12345678 passwd:\"x\" token=" + "a" * 9)]
    docs = frame(spark, rows)
    table = secrets.ratios(secrets.labelled_samples(docs))
    got = secrets.digest(secrets.scan(docs, table)).collect()
    want = Counter((d, hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert all(brute_secrets(dict(rows)[r.doc_id]) == ",".join(s for s in r.spans.split(",") if not s.startswith("markov")) for r in got if r.doc_id in (20, 21, 22))
    blob = "Zk3vQ9xT7bLw2RmY8sHd4GfJ6cNp1A5u"
    english = "the quick brown fox jumps over lazy dogs while many people watch from their windows and wonder about strange noises coming down every street under bright morning light before children leave home for school with books paper pencils lunch boxes jackets gloves hats going past gardens flowers trees houses shops markets stations bridges rivers".split()
    plain = [(i, " ".join(random.Random(i).choice(english) for _ in range(80))) for i in range(60)]
    learned = secrets.ratios(secrets.labelled_samples(frame(spark, plain)))
    extra = secrets.digest(secrets.scan(frame(spark, [(1, f"see {blob} and the_quick_brown_fox_jumps_over"), (2, "")]), learned))
    assert {r.doc_id: r.spans for r in extra.collect()} == {1: "markov:4:36", 2: ""}
    plan = secrets.scan(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secrets.digest(secrets.scan(docs.limit(0), [0.0] * len(table))).count() == 0


@pytest.mark.parametrize("hot", [100_000, 1])
def test_url_intervals(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT_ROWS", hot)
    entries = spark.createDataFrame([("b.org", "x", "add", "2024-01-10"), ("b.org", "x", "remove", "2024-02-10"), ("b.org", "x", "remove", "2024-02-10"), ("a.b.org", "y", "add", "2024-02-01"), (None, "y", "add", "2024-01-01"), ("c.org", "x", "add", "2024-01-05"), ("c.org", "x", "remove", "2024-01-05")], "domain string, category string, action string, dated string").withColumn("dated", F.to_date("dated"))
    captures = spark.createDataFrame(
        [(1, "https://u@A.b.org:80/p", "2024-01-09"), (2, "http://a.b.org?x", "2024-01-10"), (3, "http://a.b.org", "2024-02-09"), (4, "http://a.b.org", "2024-02-10"), (4, "http://a.b.org", "2024-02-10"), (5, None, "2024-02-10"), (6, "ab.org", "2024-02-10"), (7, "http://b.org", None), (8, "http://xb.org", "2024-02-01"), (9, "http://c.org.", "2024-03-01")],
        "capture_id int, url string, fetched string",
    )
    got = Counter((r.capture_id, r.blocked, r.categories) for r in url_filter.judged(captures, entries).collect())
    assert got == Counter([(1, False, ""), (2, True, "x"), (3, True, "x,y"), (4, True, "y"), (4, True, "y"), (5, False, ""), (6, False, ""), (7, False, ""), (8, False, ""), (9, False, "")])
    assert url_filter.judged(captures.limit(0), entries).count() == 0
    assert url_filter.judged(captures, entries.limit(0)).filter("blocked").count() == 0


def test_suffix_automaton_knows_all_substrings():
    rng = random.Random(1)
    text = [rng.randint(1, 3) for _ in range(60)]
    nexts = language_id.suffix_automaton(text)
    have = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(500):
        probe = tuple(rng.randint(1, 3) for _ in range(rng.randint(1, 8)))
        state = 0
        for c in probe:
            state = nexts[state].get(c, -1)
            if state < 0:
                break
        assert (state >= 0) == (probe in have)


def test_phrases_are_longest_matches():
    model = language_id.Model({"x": "abcabdabe" * 20, "y": "zzyyxxw" * 20})
    text = "abcabdzzyq" * 40
    codes = model.symbol[language_id.fold(text)]
    got = model.phrases(codes, np.array([0, len(codes)]))[:, 0]
    for k, own in enumerate(("abcabdabe" * 20, "zzyyxxw" * 20)):
        own = own[len(own) // 5 :]
        count = 0
        for low in range(0, len(text), language_id.WINDOW):
            window, at = text[low : low + language_id.WINDOW], 0
            while at < len(window):
                n = 1
                while at + n <= len(window) and window[at : at + n] in own:
                    n += 1
                at += max(1, n - 1)
                count += 1
        assert got[k] == count


def made_up(seed, letters, n):
    """Text of made-up words of the letters."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return " ".join(rng.choice(lexicon) for _ in range(n))


def test_languages_of_many_letters():
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrl1": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "cyrl2": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "arab": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"}
    letters |= {k: "".join(map(chr, range(0x4E00, 0x4E00 + 2500))) for k in ("han1", "han2")}
    text = {k: made_up(i, x, 3400) for i, (k, x) in enumerate(letters.items())}
    model = language_id.Model({k: v[:9000] for k, v in text.items()})
    names = list(text)
    data, offsets = np.frombuffer("".join(text[k][-400:] for k in names).encode(), np.uint8), np.cumsum([0] + [len(text[k][-400:].encode()) for k in names])
    assert model.predict(data, offsets)[0] == names


def test_tables_step_alike_with_and_without_places(monkeypatch):
    model = language_id.Model({k: made_up(k, "abcdefgh", 900) for k in "xyz"})
    codes = model.symbol[language_id.fold(made_up("q", "abcdefghi", 900))]
    want = model.phrases(codes, np.array([0, 300, 300, len(codes)]))
    monkeypatch.setattr(language_id, "TABLE_BYTES", 0)
    assert (model.phrases(codes, np.array([0, 300, 300, len(codes)])) == want).all()


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(100 * k + i, made_up(k, "abcdefgh", 120), f"l{k:02}") for k in range(40) for i in range(1 + (k < 36))] + [(9000, "x y", None), (9001, None, "null")]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(learned)
    assert model.languages == [f"l{k:02}" for k in range(40)]
    docs = frame(spark, [(i, t) for i, t, x in rows if x and t])
    got = {(r.doc_id, r.lang_pred) for r in language_id.predictions(docs, model).collect()}
    assert got == {(i, x) for i, t, x in rows if x and t}
    codes = model.symbol[language_id.fold(rows[0][1] + rows[70][1])]
    want = model.phrases(codes, np.array([0, len(codes)]))
    for size in (0, 1 << 20):  # several passes
        monkeypatch.setattr(language_id, "PASS_BYTES", size)
        assert (model.phrases(codes, np.array([0, len(codes)])) == want).all()


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat and the dog went over there with them " * 6) for i in range(5)]
    learned = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 3, "en").otherwise("xx")).withColumn("text", F.when(F.col("lang") == "xx", F.reverse("text")).otherwise(F.col("text")))
    model = language_id.train(learned)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predictions(frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the cat went over"), (5, "revo tnew tac eht"), (None, "the dog")]), model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "en", "xx", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predictions(learned.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.predictions(learned, language_id.train(learned.limit(0))).collect()} == {"und"}
    docs = frame(spark, [*ODD, (30, "Это кот и собака на улице рядом с домом " * 2), (31, "xqzj vvkw " * 9), (32, "the cat went over there with them and the dog"), (33, "qq")])
    kept = language_id.accepted(docs.drop("lang"), model)
    assert kept.columns == docs.drop("lang").columns
    texts = {r.text for r in kept.collect()}
    assert docs.filter("doc_id = 32 OR doc_id = 33").count() == kept.filter("doc_id = 32 OR doc_id = 33").count() and not {30, 31} & {r.doc_id for r in kept.collect()}
    assert None not in texts and "" not in texts and "   \n\t" not in texts
    assert {r.doc_id for r in language_id.accepted(docs, model, languages=["xx"]).collect()}.isdisjoint({32})
    assert language_id.accepted(docs, model, least_score=2.0).count() == 0
    assert language_id.accepted(docs, language_id.train(learned.limit(0))).count() == docs.count()


def test_training_rows_are_bounded_with_repeated_ids(spark, monkeypatch):
    rows = spark.createDataFrame([(1, f"text {i} " * 40, "en") for i in range(30)] + [(2, "mot " * 50, "fr")], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "Model", lambda texts: seen.append(texts))
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 3)
    language_id.train(rows)
    assert {k: v.count("\n") for k, v in seen[0].items()} == {"en": 3, "fr": 1}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, f"Is {words(700 + i, 14)} so? It {words(900 + i, 7)}.") for i in range(30)] + [(30, None), (31, ""), (32, "!!")]
    rows = list(ODD)
    for i in range(60):
        text = words(2000 + i, rng.randint(5, 400))
        if i % 3 == 0:
            item = items[i % 30][1]
            text = f"{text}\n{item.upper() if i % 2 else item.replace(' ', '  ')} {words(i, 9)}"
        elif i % 3 == 1:
            text += " " + items[i % 30][1].split("?")[0]  # a question without its answer
        rows.append((100 + i, text))
    marks = lambda t: [w.lower() for w in re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t or "")]
    runs = lambda t: set(zip(*(marks(t)[k:] for k in range(5)), strict=False))
    of_rows, of_items = [(d, runs(t)) for d, t in rows], [(i, runs(x)) for i, x in items]
    want = {(d, i) for d, t in of_rows for i, x in of_items if x and len(t & x) >= 0.95 * len(x)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == want and len(got) >= 20
    clean = decontaminate.clean(frame(spark, rows), benchmark)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in rows if d not in {x for x, _ in want})
    assert decontaminate.contaminated(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, rows).limit(0), benchmark).count() == 0


def test_long_items_are_verified_whole(spark):
    items = [(1, words(51, 512, 5000) + " lastword"), (2, f"{words(52, 1290, 5000)}. {words(53, 10, 5000)}."), (3, "w1 " * 600 + "end")]
    long = items[1][1].split()
    rows = [
        (1, f"{words(61, 300, 5000)} lastword {words(62, 300, 5000)}"), (2, "lastword"), (3, " ".join(long[430:860])), (4, " ".join(long[:1200])), (5, " ".join(long[-300:])),
        (10, items[0][1]), (11, f"{words(63, 700, 5000)} {items[0][1]} {words(64, 700, 5000)}"), (12, f"{words(65, 3000, 5000)} {items[1][1]} {words(66, 900, 5000)}"), (13, items[1][1]),
        (14, items[2][1]), (15, "w1 w2 end"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(10, 1), (11, 1), (12, 2), (13, 2), (14, 3)]
    assert all(r.question_overlap == 1 and r.answer_overlap == 1 for r in got)
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), benchmark).collect()} == {1, 2, 3, 4, 5, 15}


def test_items_with_one_word_changed_are_found(spark):
    items = [(i, f"{words(7000 + i, 30, 5000)}. {words(7100 + i, 10, 5000)}.") for i in range(8)]
    rows = []
    for i, text in items:
        for k in (3, 15, 26, 34, 36):
            w = text.split()
            w[k] = "changed" + "." * (k == 29)
            rows.append((100 * i + k, f"{words(7200 + i, 50, 5000)} {' '.join(w)} {words(7300 + k, 60, 5000)}"))
        question, answer = text.split(". ")
        rows.append((100 * i + 90, f"{words(7400 + i, 50, 5000)} {question}. {words(7500 + i, 40, 5000)}"))
        rows.append((100 * i + 91, f"{words(7600 + i, 50, 5000)} {answer}"))
        rows.append((100 * i + 92, " ".join("changed" if k % 9 == 4 else x for k, x in enumerate(text.split()))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == {(d, d // 100) for d, _ in rows if d % 100 < 90}


def test_pruned_scores_are_all_scores():
    items = [(i, words(40 + i, 12, 60)) for i in range(40)]
    known = decontaminate.statistics(items)
    index = decontaminate.build(items, known)
    least = dict(zip(index.items, index.least, strict=True))  # each item's threshold, of the rule that test_llm_rules holds
    rng = random.Random(9)
    text = [w for i in range(30) for w in (items[rng.randrange(40)][1] if i % 2 else words(i, 20, 60)).split()]
    hashes, step = decontaminate._words(" ".join(text)), 16
    passage = np.arange(len(hashes)) // step + 1
    got = {(q, index.items[k]): s for q, k, s in decontaminate.search(index, hashes, passage)}
    # BM25 from its definition, with plain words
    of = {i: x.split() for i, x in items}
    mean, df = sum(map(len, of.values())) / 40, Counter(w for x in of.values() for w in set(x))

    def weight(w, x):
        tf = x.count(w)
        return math.log(1 + (40 - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))

    want = {}
    for q in range(passage.max() + 1):
        held = {w for w, p in zip(text, passage, strict=True) if p in (q, q + 1)}
        for i, x in of.items():
            score = sum(weight(w, x) for w in set(x) & held)
            if score >= least[i] * (1 - 1e-9):
                want[(q, i)] = score
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_items_are_found_alike_in_one_index_or_many(spark, monkeypatch):
    items = [(i, f"Is {words(700 + i, 14)} so? It {words(900 + i, 3 + i)}.") for i in range(7)] + [(8, words(52, 700, 5000)), (9, None)]
    rows = [(i, f"{words(2000 + i, 50)} {items[i % 9][1]} {words(2100 + i, 60)}") for i in range(18)] + [(30, None), (31, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(frame(spark, rows), benchmark).collect()))
    left = sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), benchmark).collect())
    assert {(d, i) for d, i, *_ in one} == {(d, items[d % 9][0]) for d in range(18) if d % 9 != 8} and left == [8, 17, 30, 31]
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 2)
    assert sorted(map(tuple, decontaminate.contaminated(frame(spark, rows), benchmark).collect())) == one
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), benchmark).collect()) == left


def test_toxicity_learns_words(spark):
    rows = [(i, words(i, 30, 3000) + (" you loweibad thing" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(300)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows).filter("doc_id < 300"), labels)
    got = {r.doc_id: r.score for r in toxicity.scored(frame(spark, rows), model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    odd = toxicity.scored(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scored(frame(spark, rows).limit(0), model).count() == 0
    assert all(r.score < 0.7 for r in toxicity.scored(frame(spark, ODD), toxicity.train(frame(spark, rows), labels.limit(0))).collect())


def test_risk_and_its_gradient_against_plain_numpy():
    rng = np.random.default_rng(5)
    x_p, x_u = (np.hstack([rng.integers(0, 2, (n, 4)), np.ones((n, 1))]).astype(float) for n in (30, 200))
    prior, w = 0.2, rng.normal(size=5)
    log_loss = lambda x, y, v: np.mean([math.log(1 + math.exp(-y * float(r @ v))) for r in x])

    def parts(v):
        return prior * log_loss(x_p, 1, v), log_loss(x_u, -1, v) - prior * log_loss(x_p, -1, v)

    positive, negative, d_positive, d_negative = toxicity.risk(w, x_p, x_u, prior)
    assert np.allclose((positive, negative), parts(w))
    for k in range(5):
        step = np.eye(5)[k] * 1e-5
        a, b = parts(w + step), parts(w - step)
        assert np.allclose([d_positive[k], d_negative[k]], [(a[0] - b[0]) / 2e-5, (a[1] - b[1]) / 2e-5], atol=1e-6)


def test_descent_keeps_the_negatives_risk_from_falling_below_zero():
    rng = np.random.default_rng(6)
    sign = rng.random(400) < 0.25  # of the unlabelled rows; all positives have it
    x_u = np.stack([sign, rng.random(400) < 0.5, rng.random(400) < 0.5], axis=1).astype(np.float32)
    x_p = np.stack([np.ones(60), rng.random(60) < 0.5, rng.random(60) < 0.5], axis=1).astype(np.float32)
    start = math.log(0.25 / 0.75)
    w, bias = toxicity.descend(x_p, x_u, 0.25, start)
    ones = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    before = toxicity.risk(np.array([0, 0, 0, start]), ones(x_p), ones(x_u), 0.25)
    after = toxicity.risk(np.append(w, bias), ones(x_p), ones(x_u), 0.25)
    assert max(after[1], 0) + after[0] < 0.5 * (before[1] + before[0]) and after[1] > -0.02
    assert ((ones(x_u) @ np.append(w, bias) > 0) == sign).all()


def test_long_rows_are_learned_from(spark):
    long = lambda i, mark: " ".join(f"{words(10 * i + k, 500, 3000)} {mark}" for k in range(8))  # noqa: E731  over 20,000 characters
    rows = [(i, long(i, "loweibad") if i % 4 == 0 else long(i, "fine")) for i in range(160)]
    assert min(len(t) for _, t in rows) > 20_000
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows).filter("doc_id < 150"), labels)
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in toxicity.scored(frame(spark, rows).filter("doc_id >= 150"), model).collect())
    lines = lambda i, bad: "\n".join(f"{words(i * 99 + k, 6).upper()}!! | x | x" if bad else f"The {words(i * 99 + k, 6)}." for k in range(900))
    rows = [(i, lines(i, i % 4 == 0)) for i in range(16)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert len(quality.runs_of(900)) == quality.FIT_LINES // quality.RUN_LINES and quality.runs_of(900)[0][0] == 0 and quality.runs_of(400) == [(0, 400)]
    field = quality.train(frame(spark, rows).filter("doc_id < 12"), labels)
    assert all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in quality.scored(frame(spark, rows).filter("doc_id >= 12"), field).collect())
    assert quality.scored(frame(spark, rows).limit(0), field).count() == 0


def test_quality_learns_lines(spark):
    good = lambda i: "\n".join(f"The {words(i * 9 + k, 12)}." for k in range(4))
    bad = lambda i: "\n".join(f"{words(i * 9 + k, 6).upper()}!! | x | x | x" for k in range(3))
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    field = quality.train(frame(spark, rows).filter("doc_id < 150"), labels)
    got = {r.doc_id: r.score for r in quality.scored(frame(spark, rows), field).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(150, 200))
    odd = quality.scored(frame(spark, ODD), field).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.scored(frame(spark, ODD), quality.train(frame(spark, rows), labels.limit(0))).collect()} == {0.5}


def test_marginals_against_all_label_sequences():
    rng = np.random.default_rng(3)
    unary, change = rng.normal(size=9), rng.normal(size=(2, 2))
    first, count = np.array([0, 4]), np.array([4, 5])
    good, pairs = quality.marginals(unary, change, 0.3, first, count)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for f, n in zip(first, count, strict=True):
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(2**n):
            y = [(bits >> k) & 1 for k in range(n)]
            w = np.exp(0.3 * y[0] + sum(unary[f + k] * y[k] for k in range(n)) + sum(change[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            one += w * np.array(y)
            for k in range(n - 1):
                two[y[k], y[k + 1]] += w
        want[f : f + n], want_pairs = one / total, want_pairs + two / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)
