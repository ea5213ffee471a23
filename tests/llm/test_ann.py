import numpy as np
import pytest
from plumbline.llm.ann import search
from pyspark.sql import functions as F


def brute(rows, queries, k):
    out = {}
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for q, v in good:
        if q not in queries:
            continue
        scored = sorted((-float((w * v).sum() / (np.sqrt((w**2).sum()) * np.sqrt((v**2).sum()))), i) for i, w in good if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("n", [3, 400])
def test_small_tables_are_exact(spark, n):
    """A block with no more vectors than are measured at least is searched whole; with ties, copies and odd vectors."""
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(8).astype(np.float32).tolist()) for i in range(min(n, 50))]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(n // 10)] + [(2000, [2 * x for x in rows[0][1]])]
    odd = [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [1.0] * 7), (3004, [None] + [1.0] * 7), (None, rows[0][1]), (3005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows + odd], "vec_id long, embedding array<float>, score double")
    got = search(df, df.where(F.col("vec_id") % 2 == 0), 5).collect()
    want = brute([x for x in rows + odd if x[1] is None or len(x[1]) == 8], {i for i, _ in rows + odd if i is not None and i % 2 == 0}, 5)
    by = {}
    for g in sorted(got, key=lambda g: (g.query_id, g.rank)):
        by.setdefault(g.query_id, []).append((g.id, g.score))
        assert g.rank == len(by[g.query_id])
    assert {q: [i for i, _ in v] for q, v in by.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in by for a, b in zip(by[q], want[q], strict=True))


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = {}
    for g in search(df, df.where(F.col("vec_id") % 50 == 0), 5).collect():
        got.setdefault(g.query_id, {})[g.id] = g.score
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = [i in got[q] for q, v in want.items() for i, _ in v]
    assert np.mean(hits) >= 0.9
    assert all(abs(got[q][i] - s) < 1e-12 for q, v in want.items() for i, s in v if i in got[q])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(df, df).count() == 0
