import pytest
from conftest import canonical

from lathework.plans import queries
from lathework.plans.oracle import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    ours = canonical(queries.QUERIES[name](spark, small).toPandas())
    theirs = canonical(duck.sql(ORACLE_SQL[name]).df())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry_has_columns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["scope", "language", "count", "avg_anls_word", "avg_anls_char"]


def test_word_distance_against_plain_python(spark, small):
    from lathework.plans.queries import _ocr_pairs

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    want = {}
    for r in _ocr_pairs(spark, small).collect():
        a, b = r.reference_text.split(), r.predicted_text.split()
        n, d, t = want.get(r.language, (0, 0, 0))
        want[r.language] = (n + 1, d + distance(a, b), t + max(len(a), len(b)))
    got = {r.language: (r.n, r.distance, r.tokens) for r in queries.ocr_word_distance_by_lang(spark, small).collect()}
    assert got == want


def test_native_plans_have_no_python(spark, small):
    for name in ("ocr_char_error_by_lang", "ocr_word_distance_by_lang", "structured_report", "upsert_corrections", "llm_reply_parse"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_rest_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    from jobs import queries as jobs

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k.startswith('op') and k[2].isdigit() or k == 'pipeline'))"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink()
        got = subprocess.run([sys.executable, "-c", said], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        # the jobs' queries are registered beside the library's
        assert got.stdout.split() == [str(len(queries.QUERIES) + len(jobs.QUERIES)), str(len(ORACLE_SQL) + len(jobs.ORACLE_SQL)), "[]"], got.stderr


def test_html_text_of_cut_references_equals_sql(spark, tmp_path):
    """Pages whose headings end within a reference, or that have no article."""
    import duckdb
    import pandas as pd

    page = "<html><h1>no</h1><article><h1>{}</h1><p>{}</p></article></html>"
    cut = ["a&amp", "a&am", "a&", "a&amp;&amp", "&lt &#39 &quot", "&ampx; &amp;lt; &lt;b&gt; &#39;&quot;", "x & y &&&amp"]
    rows = [page.format(x, f"{x} z") for x in cut] + ["<p>no article</p>", "", None]
    pd.DataFrame({"page_id": range(len(rows)), "url": "https://e.org/", "html": rows}).to_parquet(tmp_path / "pages.parquet")
    ours = {r.page_id: r.text for r in queries.html_text(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert ours == dict(con.sql(ORACLE_SQL["html_text"]).fetchall())
