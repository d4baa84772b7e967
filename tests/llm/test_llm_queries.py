import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import canonical
from pyspark.sql import functions as F
from test_llm_operators import ODD, brute_components, brute_secrets, frame, reference_ids, words

import corpus_pipeline
from lathework.llm import queries
from lathework.llm.shared import written


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    ours = canonical(queries.QUERIES[name](spark, small).toPandas())
    assert ours == canonical(duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def rows_of(spark, small, name, kinds):
    """The rows of a query, whose columns begin with these (name, type)."""
    df = queries.QUERIES[name](spark, small)
    assert df.dtypes[: len(kinds)] == kinds
    return df.collect()


def test_op1_base_spans_of_all_documents(spark, documents, tmp_path):
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    planted = [f'api_key="{x[:20]}" {x} AKIA{x[:16].upper()} Password: {x[:7]} é token=  {x[:9]}==' for x in hexes]
    documents = [*documents, *((10_000 + i, f"{x}\n{documents[i][1]}\n{x}") for i, x in enumerate(planted)), (20_000, None)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(spark, str(tmp_path), "op1_secret_scan", [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")])
    want = {d: brute_secrets(t) for d, t in documents}
    assert {r.doc_id: r.base_sha256 for r in got} == {d: hashlib.sha256(x.encode()).hexdigest() for d, x in want.items()}
    assert len(got) == len(documents) and any(want.values())
    for r in got:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("markov"))
        assert base == want[r.doc_id] and [int(s.split(":")[1]) for s in r.spans.split(",") if s] == sorted(int(s.split(":")[1]) for s in r.spans.split(",") if s)


def test_op2_files_hold_the_ids_of_all_documents(spark, small, documents):
    got = rows_of(spark, small, "op2_simple8b", [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")])
    want, start = set(), 0
    for d, t in documents:
        ids = reference_ids("word_bpe_49k.json", t, 1)
        want.add((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert Counter(map(tuple, got)) == Counter(want)


def test_op3_pieces_hold_the_ids_of_all_documents(spark, small, documents):
    got = rows_of(spark, small, "op3_packing", [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    want = Counter()
    for d, t in documents:
        ids = reference_ids("byte_bpe_50k.json", t, 0)
        want.update((d, s, min(1024, len(ids) - s), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and sorted(used) == list(range(len(used)))
    assert 1 - sum(used.values()) / (1024 * len(used)) < 0.05


def test_op4_components_of_all_documents(spark, small, documents):
    got = rows_of(spark, small, "op4_ngram_jaccard", [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")])
    assert Counter(map(tuple, got)) == brute_components(documents, 3, 90)


def holding(documents, items):
    """(doc_id, item_id) where a document holds 0.8 of an item's five-word runs, by plain sets."""
    marks = lambda t: [w.lower() for w in re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t or "")]
    runs = lambda t: set(zip(*(marks(t)[k:] for k in range(5)), strict=False))
    of = [(i, runs(x)) for i, x in items]
    return {(d, i) for d, t in documents for mine in [runs(t)] for i, x in of if x and len(mine & x) >= 0.8 * len(x)}


def test_op9_items_in_all_documents(spark, small, documents, duck):
    got = rows_of(spark, small, "op9_decontaminate", [("doc_id", "bigint"), ("item_id", "bigint")])
    want = holding(documents, duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    assert {(r.doc_id, r.item_id) for r in got} == want and want


#: query, modulus and remainder of what is held out, least score of a 1, and the column that is learned
LEARNED = [("op6_language_id", 4, 2, None, "lang"), ("op8_toxicity", 3, 1, 0.7, "toxic"), ("op10_quality", 3, 1, 0.5, "quality")]


@pytest.mark.parametrize(("name", "modulus", "value", "least", "column"), LEARNED)
def test_what_is_held_out_teaches_nothing(spark, tmp_path, name, modulus, value, least, column):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kinds = [("doc_id", "bigint"), ("held_out", "boolean")] + ([("lang_pred", "string"), ("score", "double")] if least is None else [("score", "double"), ("predicted", "int")])
    got = {r.doc_id: r for r in rows_of(spark, folder, name, kinds)}
    held = lambda d: zlib.crc32(str(d).encode()) % modulus == value
    assert {d: r.held_out for d, r in got.items()} == {r.doc_id: held(r.doc_id) for r in docs.select("doc_id").collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    if least is not None:
        assert all(r.predicted == int(r.score >= least) for r in got.values()) and 0 < sum(r.predicted for r in got.values()) < len(got)
    # other labels, languages and sources where they mustn't count
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value
    if column == "lang":
        docs = docs.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    else:
        labels = labels.withColumn(column, F.when(out, 1 - F.col(column)).otherwise(F.col(column)))
        docs = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    again = {r.doc_id: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert all(abs(again[d].score - r.score) < 1e-9 and again[d][2 if least is None else 3] == r[2 if least is None else 3] for d, r in got.items())


def brute_pipeline(rows, items):
    """Rows (doc_id, text) after each of the first four stages, by plain loops. All languages fit here."""
    out, now = [], [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    out.append(now)
    best = {}
    for d, t in now:
        if t not in best or best[t] is None or d is not None and d > best[t]:
            best[t] = d
    now = [(d, t) for t, d in best.items()]
    out.append(now)
    # components by their first row: numbers in place of doc_ids, null last and rows of one doc_id apart
    order = sorted(range(len(now)), key=lambda i: (now[i][0] is None, now[i][0] or 0))
    label = {i: c for i, _, c in brute_components([(k, now[i][1]) for k, i in enumerate(order)], 5, 80)}
    now = [now[i] for k, i in enumerate(order) if label[k] == k]
    out.append(now)
    dirty = {d for d, _ in holding(list(enumerate(t for _, t in now)), items)}
    out.append([r for k, r in enumerate(now) if k not in dirty])
    return out


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    base = [(i, words(3000 + i, 60)) for i in range(100, 112)]
    items = [(i, f"Is {words(700 + i, 14)} so? It {words(900 + i, 9)}.") for i in range(5)] + [(9, None)]
    rows = [*ODD, *base, (300, base[0][1] + " tail"), (100, words(5, 70)), (301, base[1][1]), (302, base[1][1]), (None, base[2][1] + " end"), (303, "12 34"), (303, f"{words(6, 40)} {items[2][1]} {words(7, 40)}")]
    letters = str.maketrans("0123456789", "aeioustrnl")  # the language stage looks at letters
    rows = [(d, t if t is None or t == "12 34" else t.translate(letters)) for d, t in rows]
    items = [(i, t and t.translate(letters)) for i, t in items]
    rng.shuffle(rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows)
    for c in ("_gone", "_gone_id", "_k", "_keep", "_r", "_digest", "_row", "key", "piece", "length", "rows"):
        docs = docs.withColumn(c, F.lit("c"))
    before = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], brute_pipeline(rows, items), strict=False):
        before = written(stage(spark, before, str(tmp_path)), name)
        assert before.schema.simpleString() == docs.schema.simpleString()
        assert Counter((r.doc_id, r.text) for r in before.collect()) == Counter(want), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert sum(r.length for r in pieces) == sum(len(reference_ids("byte_bpe_50k.json", r.text, 0)) for r in before.collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline_stages_follow_each_other(spark, small, duck):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, small), name)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in after.collect()}
        before = after
    texts = Counter(kept["exact_dedup"].values())
    assert max(texts.values()) == 1 and set(texts) == set(kept["language_id"].values())
    items = [r[0] for r in duck.sql("SELECT text FROM benchmark").fetchall()]
    holding = {d for d, t in kept["near_dedup"].items() if any(x in t for x in items)}
    assert holding and not holding & set(kept["decontaminate"])
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == holding
    packed = corpus_pipeline.STAGES[-1][1](spark, before, small).toPandas()
    whole = packed.groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "first"))
    assert set(whole.index) == set(kept["decontaminate"]) and (whole.length == whole.tokens).all()
