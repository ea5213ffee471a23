"""Embedding whitening against numpy's own decomposition and exact integers."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, whitening

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<double>, id string, n int, vec int, whitened int"


def brute(rows, k=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    m = np.array(x, float) - np.array(s) / n
    v = m.T @ m / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, deviation, m @ w / np.sqrt(e), e / np.trace(v)


def test_query_is_what_numpy_finds(spark):
    src = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in src.collect()]
    n, deviation, white, share = brute(rows)
    got = defaultdict(dict)
    for r in queries.op12_feast_whitening(spark, SF).collect():
        got[r.vec_id][r.component] = r
    assert set(got) == {i for i, _ in rows} and all(set(x) == set(range(1, 9)) for x in got.values())
    mine = np.array([[got[i][c].whitened for c in range(1, 9)] for i, _ in rows])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * sign).max() < 1e-8
    for at, (i, _) in enumerate(rows):
        r = got[i][3]
        assert r.n == n and r.deviation == deviation[at] and abs(r.explained / share[2] - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("n", [1, 2, 9, 40, 64])
def test_components_of_random_matrices(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    a = a @ a.T
    e, w = whitening.largest_components(a, 8)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:8], rtol=1e-10)
    assert np.abs(w.T @ w - np.eye(len(e))).max() < 1e-12 and np.abs(a @ w - w * e).max() < 1e-11 * e[0]
    for shift in (-1.0, e[0] / 3, e[0] * 0.99, e[0] + 1):
        assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_equal_eigenvalues_are_all_found():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))
    a = q @ np.diag([7.0] * 6 + [7 - 1e-9] * 3 + [1.0] * 11 + [0.0] * 10) @ q.T
    e, w = whitening.largest_components((a + a.T) / 2, 12)
    assert np.allclose(e, [7.0] * 9 + [1.0] * 3) and np.abs(w.T @ w - np.eye(12)).max() < 1e-12
    assert len(whitening.largest_components(a, 30)[0]) == 20
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]]), 0) == 1


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 3.0]), (1, [0.5, -0.25, 3.0]), (None, [1.0, 2.0, -1.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 0.0, 0.0]), (8, []), (9, [1.0]), (10, [0.0, 0.0, 0.0]), (11, [-2.5, 1.5, 0.125])]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROW)
    got = whitening.whiten(df).collect()
    fit = [r for r in rows if r[1] and len(r[1]) == 3 and None not in r[1] and all(map(math.isfinite, r[1]))]
    n, deviation, white, _ = brute(fit, 3)
    assert len(got) == 3 * len(fit) and {r.n for r in got} == {5} and max(r.identity_error for r in got) < 1e-9
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 2), sorted(np.abs(white[:, 1])))


def test_nothing_to_whiten_and_few_dimensions(spark):
    assert whitening.whiten(spark.createDataFrame([], ROW)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], "", 0, 0, 0) for i in range(5)], ROW)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i)], "", 0, 0, 0) for i in range(5)], ROW)).collect()
    assert len(flat) == 5 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e18, 1.0]), (2, [-1e18, 2.0]), (3, [5.0, 1e300])]
    got = whitening.whiten(spark.createDataFrame([(*r, "", 0, 0, 0) for r in rows], ROW))
    assert got.where(F.col("deviation").isNotNull()).count() == 0 and got.select("id").distinct().count() == 3
    big = [(i, [float(i * 10**5), 1.0]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame([(*r, "", 0, 0, 0) for r in big], ROW)).where("component = 1").collect()
    assert sorted(r.deviation for r in got) == sorted(brute(big, 1)[1])
