"""Whitening and near-duplicate embeddings on odd rows and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import projection_passes, queries, whitening
from lathework.llm.shared import written

SCHEMA = "vec_id long, embedding array<float>, label int, n long, key long, h1 long, parent long, x string, links long"


def table_of(spark, rows, kind="float", parts=3):
    """rows: (vec_id, entries); the other columns clash with the operators' own names."""
    schema = SCHEMA.replace("array<float>", f"array<{kind}>")
    return spark.createDataFrame([(i, v, None, 1, None, 2, 3, "x", None) for i, v in rows], schema).repartition(parts)


def rows_like(seed, n, d=6):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(rng.normal(size=(n, d)))]


# ---------------------------------------------------------------- whitening


def brute_whitening(rows, components=16):
    """n, deviations, whitened (up to signs), explained by whole-number arithmetic and one covariance of all."""
    vectors = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    fitted = sorted({tuple(v) for v in vectors})
    n, d = len(fitted), len(fitted[0])
    sums = [sum(v[k] for v in fitted) for k in range(d)]
    deviation = [sum((n * v[k] - sums[k]) ** 2 for k in range(d)) for v in vectors]
    centre = lambda vs: np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for v in vs])
    c = centre(fitted)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:components]
    return n, deviation, centre(vectors) @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_of_all_embeddings(spark, small, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    n, deviation, white, explained = brute_whitening(rows)
    df = queries.QUERIES["op11_embedding_whitening"](spark, small)
    assert df.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(got) == 16 * len(rows)
    for i, (vec_id, _) in enumerate(rows):
        for k in range(16):
            r = got[vec_id, k + 1]
            assert (r.n, r.deviation) == (n, deviation[i]) and abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9
    for k in range(16):
        ours = np.array([got[vec_id, k + 1].whitened for vec_id, _ in rows])
        assert min(np.abs(ours - white[:, k]).max(), np.abs(ours + white[:, k]).max()) < 1e-6


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_of_odd_rows(spark, kind):
    good = rows_like(1, 40)
    twice = [(100, good[0][1]), (100, good[0][1]), (None, good[1][1]), *((200 + i, good[2][1]) for i in range(30))]
    odd = [(300, None), (301, []), (302, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (303, [float("nan")] * 6), (304, [float("inf")] + [1.0] * 5), (305, [1.0, 2.0]), (306, [3e37] * 6)]
    n, deviation, white, explained = brute_whitening(good + twice)
    got = whitening.whiten(table_of(spark, good + twice + odd, kind), components=4).collect()
    assert len(got) == 4 * len(good + twice) and {r.n for r in got} == {n} == {40}
    want = sorted((-1 if v is None else v, int(x)) for (v, _), x in zip(good + twice, deviation, strict=True))
    assert sorted((-1 if r.vec_id is None else r.vec_id, int(r.deviation)) for r in got if r.component == 1) == want
    assert max(r.identity_error for r in got) < 1e-9
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        if r.vec_id is not None and r.vec_id < 40:
            assert abs(abs(r.whitened) - abs(white[r.vec_id, r.component - 1])) < 1e-9


def test_whitening_without_variance_or_rows(spark):
    same = whitening.whiten(table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same) == [(v, k, 1, 0, None, None, None) for v in (1, 2) for k in (1, 2)]
    line = whitening.whiten(table_of(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all(r.whitened is None for r in line if r.component == 2) and all(r.whitened is not None for r in line if r.component == 1)
    assert max(r.identity_error for r in line) < 1e-9
    assert whitening.whiten(table_of(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table_of(spark, rows_like(2, 3)).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(i, [float((-1) ** i * 2**40 + i), float(i), -(2.0**41)]) for i in range(7)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(table_of(spark, rows, "double")).collect()}
    assert got == dict(zip(range(7), brute_whitening(rows)[1], strict=True))


# ---------------------------------------------------------------- near duplicates


def brute_links(rows, threshold):
    """n_links and component_id of each row by comparing all pairs."""
    can = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if c else None for (_, v), c in zip(rows, can, strict=True)]
    linked = [[j for j in range(len(rows)) if j != i and can[i] and can[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((rows[i][0], len(linked[i]), component, rows[i][0] == component))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(seed, spreads, d=24):
    """Clusters of so many vectors at so much noise around a centre, and lone vectors."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=d) for _ in range(60)]
    for size, noise in spreads:
        centre = rng.normal(size=d)
        out += [centre + noise * rng.normal(size=d) for _ in range(size)]
    order = rng.permutation(len(out))
    return [(int(i), [float(np.float32(x)) for x in out[k]]) for i, k in enumerate(order)]


def test_near_duplicates_of_all_embeddings_have_no_false_link(spark, small, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    df = queries.QUERIES["op12_embedding_near_dedup"](spark, small)
    assert df.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert as_rows(df) == sorted(brute_links(rows, 0.95), key=str)


def test_near_duplicates_of_clusters_tight_and_wide(spark):
    """Tight balls, clusters as wide as the threshold, and balls that are linked in part."""
    rows = clustered(3, [(80, 0.02), (60, 0.15), (40, 0.2), (30, 0.1), (90, 0.21)])
    want = brute_links(rows, 0.95)
    got = as_rows(projection_passes.near_duplicates(table_of(spark, rows), 0.95, window=16))
    by_id = {r[0]: r for r in want}
    assert all(r[1] <= by_id[r[0]][1] for r in got)  # no link below the threshold
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want) > 1000
    assert sum(r[2] == by_id[r[0]][2] for r in got) >= 0.97 * len(rows)


def test_balls_linked_in_part_are_compared_by_members(spark):
    """Two balls of radius up to 8 degrees, 20 degrees apart: some members link, others don't."""
    rng = random.Random(5)
    rows, turn = [], lambda deg, tilt: [math.cos(math.radians(deg)), math.sin(math.radians(deg)), math.sin(math.radians(tilt)), 0.0]
    for i in range(60):
        rows.append((i, turn((0 if i % 2 else 20) + rng.uniform(-6, 6), rng.uniform(-2, 2))))
    want = brute_links(rows, 0.95)
    assert len({r[1] for r in want}) > 10
    assert as_rows(projection_passes.near_duplicates(table_of(spark, rows, "double"), 0.95)) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_duplicates_of_odd_rows(spark, kind):
    base = rows_like(7, 30, 8)
    near = [(100 + i, [x * (1 + i) for x in base[0][1]]) for i in range(5)]
    odd = [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] * 8), (205, [float("inf")] * 8), (206, [1.0]), (207, [2.0]), (208, [-0.0] + [1.0] * 7), (209, [0.0] + [1.0] * 7)]
    repeats = [(0, base[0][1]), (0, base[0][1]), (None, base[1][1]), (None, [0.5] * 8), (None, [0.5] * 8), (300, base[1][1]), *((400 + i, base[2][1]) for i in range(50))]
    huge = [(500, [1e30 if kind == "float" else 1e300, 1.0] + [0.0] * 6), (501, [1e30 if kind == "float" else 1e300, 5.0] + [0.0] * 6), (502, [1e-30] * 8)]
    rows = base + near + odd + repeats + huge
    unit = [(i, None if v is None else [x / 1e290 if x is not None and abs(x) > 1e200 else x for x in v]) for i, v in rows]
    want = brute_links(unit, 0.95)
    got = projection_passes.near_duplicates(table_of(spark, rows, kind), 0.95)
    assert as_rows(got) == sorted(want, key=str)


def test_near_duplicates_without_rows(spark):
    assert projection_passes.near_duplicates(table_of(spark, base := rows_like(1, 2)).limit(0)).collect() == []
    assert as_rows(projection_passes.near_duplicates(table_of(spark, [base[0]]))) == [(0, 0, 0, True)]


def test_windows_reach_across_tasks(spark):
    """Many more tasks than a window has rows give the pairs of one task."""
    rows = clustered(11, [(20, 0.1), (25, 0.12)])
    each = written(projection_passes.keyed(projection_passes.classes(table_of(spark, rows)), "float", 2), "few")
    found = []
    for parts in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            found.append(sorted(map(tuple, written(projection_passes.window_pairs(each, "float", 1, math.acos(0.9), 12).select(F.least("a", "b"), F.greatest("a", "b")).toDF("a", "b"), "found").distinct().collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) > 50


def test_passes_grow_with_rows():
    at = [projection_passes.passes_for(n, 0.95) for n in (100, 10_000, 1_000_000, 10**9)]
    assert at[0] == 1 and at == sorted(at) and at[-1] < 100
