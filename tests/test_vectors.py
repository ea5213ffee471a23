"""Nearest vectors, agreement of views and separation of classes against all pairs."""

import numpy as np
import pytest
from plumbline.operators import vectors as op


def frame(spark, rows):
    return spark.createDataFrame(rows, "view string, item long, label string, x array<double>")


def units(rows):
    out = []
    for view, item, label, x in rows:
        a = np.array([np.nan if v is None else v for v in x]) if x is not None else np.array([np.nan])
        n = np.sqrt((a * a).sum())
        if np.isfinite(n) and n > 0:
            out.append((view, item, label, a / n))
    return out


def by_all_pairs(rows):
    out = {}
    for v, i, _, a in units(rows):
        best = sorted((-round(float(a @ b), 12), j) for w, j, _, b in units(rows) if w == v and j != i)
        out[v, i] = best[0][1] if best else None
    return out


def clustered(rng, clusters, each, dims, spread):
    middles = rng.normal(size=(clusters, dims)) * 10
    return np.concatenate([m + spread * rng.normal(size=(each, dims)) for m in middles])


@pytest.mark.parametrize("pivots", [None, 1, 7, 64])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(op, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = np.concatenate([clustered(rng, 6, 40, 8, 0.5), rng.normal(size=(60, 8)), np.ones((30, 8)), 2 * np.ones((5, 8))])
    rows = [("a", k, "l", v.tolist()) for k, v in enumerate(x)] + [("b", k, "l", (v + 0.3).tolist()) for k, v in enumerate(x[:50])]
    rows += [("b", 900, "l", None), ("b", 901, "l", [0.0] * 8), ("b", 902, "l", [1.0, None] + [1.0] * 6), ("b", 903, "l", [float("nan")] + [1.0] * 7), ("c", 1, "l", [1.0] * 8)]
    got = op.nearest_vectors(frame(spark, rows), ["view"], "item", "x", pivots).collect()
    assert {(r.view, r.item): r.nearest for r in got} == by_all_pairs(rows)
    assert len(got) == len(x) + 51 and all(1 <= r.opened <= r.blocks for r in got)


def test_blocks_are_left_out_where_there_is_structure(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = clustered(rng, 20, 60, 16, 0.05)
    rows = [("a", k, "l", v.tolist()) for k, v in enumerate(x)]
    got = op.nearest_vectors(frame(spark, rows), ["view"], "item", "x", 64).collect()
    assert {(r.view, r.item): r.nearest for r in got} == by_all_pairs(rows)
    assert sum(r.opened for r in got) < 0.4 * sum(r.blocks for r in got)


def test_one_text_holds_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 32)
    rng = np.random.default_rng(6)
    rows = [("a", k, "l", [1.0, 2.0, 3.0] if k % 3 == 0 else rng.normal(size=3).tolist()) for k in range(600)]
    got = {r.item: r for r in op.nearest_vectors(frame(spark, rows), ["view"], "item", "x").collect()}
    assert {("a", k): r.nearest for k, r in got.items()} == by_all_pairs(rows)
    assert got[0].nearest == 3 and got[597].nearest == 0


def test_empty_and_clashing(spark):
    assert op.nearest_vectors(frame(spark, []), ["view"], "item", "x").collect() == []
    assert op.nearest_vectors(frame(spark, [("a", 1, "l", None)]), ["view"], "item", "x").columns == ["view", "item", "nearest", "cosine", "blocks", "opened"]
    assert op.view_agreement(frame(spark, []), "view", "item", "x").collect() == []
    assert op.class_separation(frame(spark, []), "view", "item", "label", "x", [("p", "q")]).collect() == []
    with pytest.raises(ValueError):
        op.nearest_vectors(frame(spark, []).withColumnRenamed("view", "u"), ["u"], "item", "x")


def test_agreement(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 5))
    moved = {"a": x, "b": x + 0.2 * rng.normal(size=x.shape), "c": (x * 3)[:80]}
    rows = [(v, k, "l", y.tolist()) for v, ys in moved.items() for k, y in enumerate(ys)]
    near, unit = by_all_pairs(rows), {(v, i): a for v, i, _, a in units(rows)}
    got = {(r.view_a, r.view_b): r for r in op.view_agreement(frame(spark, rows), "view", "item", "x").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (v, w), r in got.items():
        both = [i for i in range(120) if (v, i) in unit and (w, i) in unit]
        assert r["items"] == len(both)
        assert r.mean_cosine == pytest.approx(np.mean([unit[v, i] @ unit[w, i] for i in both]), abs=1e-12)
        assert r.stability == pytest.approx(np.mean([near[v, i] == near[w, i] for i in both]))
    assert got["a", "c"].mean_cosine == pytest.approx(1)


def test_separation(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = []
    for v in ("a", "b"):
        for k in range(130):
            label = "pqr"[k % 3] if k < 129 else "alone"
            rows.append((v, k, label, (rng.normal(size=4) + (2 if label == "p" else 0)).tolist()))
    got = {(r.view, r.class_a, r.class_b): r for r in op.class_separation(frame(spark, rows), "view", "item", "label", "x", [("p", "q"), ("q", "r"), ("p", "none"), ("alone", "p")]).collect()}
    for v in ("a", "b"):
        by = {c: [a for w, _, label, a in units(rows) if w == v and label == c] for c in ("p", "q", "r", "alone")}
        for one, two in (("p", "q"), ("q", "r")):
            same = [np.rint(10000 * (s @ t)) for n, s in enumerate(by[one]) for t in by[one][n + 1 :]]
            cross = [np.rint(10000 * (s @ t)) for s in by[one] for t in by[two]]
            auc = np.mean([1.0 if s > t else 0.5 if s == t else 0.0 for s in same for t in cross])
            r = got[v, one, two]
            assert (r.same, r.cross) == (len(same), len(cross)) and r.auc == pytest.approx(auc, abs=1e-9)
        assert (got[v, "p", "none"].cross, got[v, "p", "none"].auc) == (0, None)
        assert (got[v, "alone", "p"].same, got[v, "alone", "p"].auc) == (0, None)
