"""Rays through chunks against a loop over a whole array; probes along normals."""

import math

import numpy as np
import pytest
from plumbline.operators import rays as op
from plumbline.operators.surfaces import centred_normals
from pyspark.sql import functions as F

SIZE = (8, 8, 8)


def chunked(spark, pred, support, as_bytes, leave_out=()):
    rows = []
    for cz, cy, cx in np.ndindex(*[-(-n // s) for n, s in zip(pred.shape, SIZE, strict=True)]):
        if (cz, cy, cx) in leave_out:
            continue
        cut = tuple(slice(c * s, c * s + s) for c, s in zip((cz, cy, cx), SIZE, strict=True))
        pair = []
        for a in (pred, support):
            whole = np.zeros(SIZE, np.uint8)
            part = a[cut]
            whole[tuple(slice(0, n) for n in part.shape)] = part
            pair.append(bytearray(whole.tobytes()) if as_bytes else [int(v) for v in whole.ravel()])
        rows.append(("v", cz, cy, cx, *pair))
    kind = "binary" if as_bytes else "array<int>"
    return spark.createDataFrame(rows, f"scan string, cz int, cy int, cx int, pred {kind}, ct {kind}")


def rays_of(spark, rows, shape):
    df = spark.createDataFrame(rows, "scan string, id long, pz double, py double, px double, nz double, ny double, nx double")
    return df.withColumns({"hz": F.lit(shape[0]), "hy": F.lit(shape[1]), "hx": F.lit(shape[2])})


def march(spark, pred, support, rows, as_bytes=True, leave_out=(), nearest=12, most=32, gap=3, run=2):
    chunks = chunked(spark, pred, support, as_bytes, leave_out)
    return op.ray_march(rays_of(spark, rows, pred.shape), chunks, ["scan"], ["id"], SIZE, ("hz", "hy", "hx"), "pred", "ct", 127, nearest, most, gap, run)


def loop(pred, support, ray, nearest, most, gap, run):
    """(sign, start, end) of the chosen run, by looking at one step at a time."""
    found = []
    for sign in (-1, 1):
        seen = []
        for d in range(1, most + 1):
            at = [math.floor(p + sign * d * n + 0.5) for p, n in zip(ray[:3], ray[3:], strict=True)]
            if not all(0 <= k < s for k, s in zip(at, pred.shape, strict=True)):
                seen.append("-")
            elif pred[tuple(at)] <= 127:
                seen.append("clear")
            else:
                seen.append("hit" if support[tuple(at)] > 0 else "-")
        for start in range(nearest, most - run + 2):
            before, there = seen[start - 1 - gap : start - 1], seen[start - 1 : start - 1 + run]
            if before == ["clear"] * gap and there == ["hit"] * run:
                end = start + run - 1
                while end < most and seen[end] == "hit":
                    end += 1
                found.append(((start + end) / 2, sign, start, end))
                break
    return min(found)[1:] if found else (None, None, None)


@pytest.mark.parametrize("as_bytes", [True, False])
def test_march_is_the_loop(spark, as_bytes):
    rng = np.random.default_rng(5)
    pred = np.where(rng.random((30, 25, 40)) < 0.5, 0, 200).astype(np.uint8)
    support = (rng.random(pred.shape) < 0.9).astype(np.uint8)
    pred[8:16, 8:16, 16:24] = 0  # a chunk that is not there reads as zeros
    rays = []
    for _ in range(300):
        n = rng.normal(size=3)
        n /= np.sqrt((n * n).sum())
        rays.append((*(rng.random(3) * pred.shape).tolist(), *n.tolist()))
    got = march(spark, pred, support, [("v", k, *r) for k, r in enumerate(rays)], as_bytes, {(1, 1, 2)}, 4, 20, 2, 2).collect()
    assert len(got) == 300
    want = {k: loop(pred, support, r, 4, 20, 2, 2) for k, r in enumerate(rays)}
    assert {r.id: (r.sign, r.start, r.end) for r in got} == want
    assert {r.status for r in got} == {"found", "no_separated_run"}


def test_nearest_wins_and_negative_breaks_a_tie(spark):
    pred, ct = np.zeros((16, 16, 96), np.uint8), np.ones((16, 16, 96), np.uint8)
    pred[8, 8, 27:29] = 255  # 20 and 21 below
    pred[8, 8, 68:70] = 255  # 20 and 21 above
    pred[4, 4, 28:30] = pred[4, 4, 66:68] = 255  # 19 below, 18 above
    rows = march(spark, pred, ct, [("v", k, y, y, 48.0, 0.0, 0.0, 1.0) for k, y in ((0, 8.0), (1, 4.0))]).orderBy("id").collect()
    assert [(r.sign, r.distance, r.x, r.vx) for r in rows] == [(-1, -20.5, 27.5, 28), (1, 18.5, 66.5, 67)]


def test_support_makes_no_gap_and_a_run_needs_one(spark):
    pred, ct = np.zeros((16, 16, 96), np.uint8), np.ones((16, 16, 96), np.uint8)
    pred[8, 8, 57:62] = 255  # 9 to 13, without support at 9 to 11
    ct[8, 8, 57:60] = 0
    pred[4, 4, 58:62] = 255  # 10 to 13 starts too near
    pred[4, 4, 68:70] = 255
    rows = march(spark, pred, ct, [("v", k, y, y, 48.0, 0.0, 0.0, 1.0) for k, y in ((0, 8.0), (1, 4.0))]).orderBy("id").collect()
    assert [(r.status, r.start, r.end) for r in rows] == [("no_separated_run", None, None), ("found", 20, 21)]
    assert rows[0].hits_above == 2


def test_outside_is_neither(spark):
    pred, ct = np.zeros((16, 16, 16), np.uint8), np.ones((16, 16, 16), np.uint8)
    rows = march(spark, pred, ct, [("v", 0, 8.0, 8.0, 3.0, 0.0, 0.0, 1.0), ("v", 1, float("nan"), 8.0, 3.0, 0.0, 0.0, 1.0), ("v", 2, 8.0, 8.0, 3.0, None, 0.0, 1.0), ("w", 3, 8.0, 8.0, 3.0, 0.0, 0.0, 1.0)])
    assert sorted((r.id, r.status, r.inside_below, r.inside_above) for r in rows.collect()) == [(0, "no_separated_run", 3, 12), (1, "no_separated_run", 0, 0), (2, "no_separated_run", 0, 0), (3, "no_separated_run", 3, 12)]
    assert march(spark, pred, ct, []).collect() == []


def test_a_chunk_that_all_rays_cross(spark, monkeypatch):
    monkeypatch.setattr(op, "LEGS", 16)
    pred, ct = np.zeros((16, 16, 40), np.uint8), np.ones((16, 16, 40), np.uint8)
    pred[:, :, 20:23] = 255
    rows = march(spark, pred, ct, [("v", k, 8.0, 8.0, 1.0, 0.0, 0.0, 1.0) for k in range(500)]).collect()
    assert len(rows) == 500 and {(r.sign, r.start, r.end) for r in rows} == {(1, 19, 21)}


def test_refusals(spark):
    one = np.zeros((8, 8, 8), np.uint8)
    for wrong in ({"nearest": 3}, {"most": 12}, {"gap": 0}, {"run": 0}):
        with pytest.raises(ValueError):
            march(spark, one, one, [], **wrong)


def test_probe_plan(spark):
    rows, slope = [], 0.5
    for r in range(12):
        for c in range(14):
            rows.append((1, r, c, 10.0 + 4 * c, 10.0 + 4 * r, 40.0 + slope * 4 * c, (r, c) != (6, 6)))
    rows = [x for x in rows if x[1:3] != (3, 9)]  # a hole: its neighbours along the row are not neighbours
    grid = spark.createDataFrame(rows, "s int, row int, col int, x double, y double, z double, valid boolean")
    n = centred_normals(grid, "s")
    have = {(r.row, r.col) for r in n.collect()}
    lost = {(r + a, c + b) for r, c in ((6, 6), (3, 9)) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    assert have == {(r, c) for r in range(1, 11) for c in range(1, 13)} - lost
    length = math.sqrt(1 + slope * slope)
    assert all(abs(r.nx + slope / length) < 1e-12 and abs(r.ny) < 1e-12 and abs(r.nz - 1 / length) < 1e-12 for r in n.collect())
    plan = op.probe_plan(n, ["s"], ["row", "col"], [-6, 6], 2, (67, 200, 200), 10).collect()
    fits = [(r.row, r.col) for r in sorted(n.collect()) if math.ceil(r.z + 6 * r.nz) + 3 <= 67]
    assert len(fits) < len(have)
    assert sorted((r.row, r.col) for r in plan) == [fits[int((i + 0.5) * len(fits) / 10)] for i in range(10)]
    for r in plan:
        assert r.enough and r.eligible == len(fits) and [p.offset for p in r.points] == [0.0, -6.0, 6.0]
        for a in op.AXES:
            v = [p[a] for p in r.points]
            assert (r[f"{a}0"], r[f"{a}1"]) == (math.floor(min(v)) - 2, math.ceil(max(v)) + 3)
    assert not any(r.enough for r in op.probe_plan(n, ["s"], ["row", "col"], [6], 2, (67, 200, 200), 1000).collect())
