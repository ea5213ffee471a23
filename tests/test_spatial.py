"""Nearest rings, dominators and the sign test against loops."""

import math
import random

import pytest
from plumbline.operators import evaluation, spatial


@pytest.mark.parametrize("axes", [2, 3])
def test_nearest_on_skewed_points(spark, axes):
    """Most points in one small spot, the rest far and wide; ties, equal places, missing places and keys without targets."""
    rng = random.Random(axes)
    names = "xyz"[:axes]

    def place(k):
        return tuple(round(rng.gauss(0, 0.01), 4) if k % 20 else rng.uniform(-60, 60) for _ in names)

    targets = [(rng.choice("ab"), k, *place(k)) for k in range(3000)] + [("a", 9000 + k, *([7.0] * axes)) for k in range(300)] + [("a", 8000, *([None] * axes)), ("c", 1, *([0.0] * axes))]
    queries = [(rng.choice("ab"), k, *place(k)) for k in range(400)] + [("a", 900, *([7.5] * axes)), ("a", 901, *([500.0] * axes)), ("d", 902, *([0.0] * axes)), ("a", 903, *([None] * axes))]
    cols = ", ".join(f"{n} double" for n in names)
    got = spatial.nearest(spark.createDataFrame(queries, f"f string, q long, {cols}"), spark.createDataFrame(targets, f"f string, t long, {cols}"), ["f"], list(names), "q", "t", 5.0, 30.0)
    want = {}
    for f, q, *at in queries:
        near = [] if at[0] is None else [(round(math.dist(at, to), 9), t) for g, t, *to in targets if g == f and to[0] is not None and math.dist(at, to) <= 30]
        want[q] = min(near) if near else (None, None)
    assert {r.q: (r.d, r.t) for r in got.collect()} == want
    assert want[901] == want[902] == want[903] == (None, None) and want[900][1] == 9000


def test_nearest_without_targets(spark):
    q = spark.createDataFrame([("a", 1, 0.0)], "f string, q long, x double")
    t = spark.createDataFrame([], "f string, t long, x double")
    assert [tuple(r) for r in spatial.nearest(q, t, ["f"], ["x"], "q", "t", 1.0, 5.0).collect()] == [("a", 1, None, None)]


@pytest.mark.parametrize("cells", [1024, 9])
def test_dominators_are_all_pairs(spark, cells):
    rng = random.Random(cells)
    rows = [(k, float(rng.randint(0, 12)), rng.gauss(0, 1), float(rng.choice([1, 1, 1, 2, 5]))) for k in range(250)] + [(900, None, 1.0, 1.0), (901, 3.0, 0.5, 1.0), (902, 3.0, 0.5, 1.0)]
    got = spatial.dominators(spark.createDataFrame(rows, "k long, a double, b double, c double"), "k", ["a", "b"], ["c"], cells)
    good = [r for r in rows if None not in r]
    want = {(x[0], y[0]) for x in good for y in good if y[1] >= x[1] and y[2] >= x[2] and y[3] <= x[3] and y[1:] != x[1:]}
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    front = {r.k for r in spatial.pareto(spark.createDataFrame(rows, "k long, a double, b double, c double"), "k", ["a", "b"], ["c"]).collect()}
    assert front == {r[0] for r in good} - {a for a, _ in want}


def test_sign_test_is_exact(spark):
    rng = random.Random(1)
    rows = []
    for g, (n, pos) in enumerate([(0, 0), (1, 0), (1, 1), (10, 10), (10, 0), (11, 6), (10, 5), (200, 90), (200, 130), (4000, 2100), (4000, 1900)]):
        rows += [(g, 1.0 if k < pos else -1.0) for k in range(n)] + [(g, 0.0)] * rng.randint(1, 3)
    got = {r.g: (r.n, r.pos, r.p) for r in evaluation.sign_test(spark.createDataFrame(rows, "g int, d double"), ["g"], "d").collect()}
    for n, pos, p in got.values():
        want = sum(math.comb(n, k) for k in range(pos, n + 1)) / 2**n if n else 1.0
        assert p == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_sign_test_of_many_pairs_takes_few_steps(spark):
    df = spark.range(3_000_000).selectExpr("1 AS g", "IF(id < 1501000, 1.0D, -1.0D) AS d")
    p = evaluation.sign_test(df, ["g"], "d").first().p
    z = (1_501_000 - 0.5 - 1_500_000) / math.sqrt(3_000_000 / 4)
    assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-4)
