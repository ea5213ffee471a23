"""Landmark registrations and release findings on small cases."""

import hashlib

import numpy as np
import pytest
from plumbline.operators import records as op

MATRIX = np.array([[2.0, 0, 0.5, 10], [0, 1.5, 0, -4], [0.25, 0, 3, 7]])
MARKS = "id string, fx double, fy double, fz double, mx double, my double, mz double"


def registered(spark, cases):
    t = spark.createDataFrame([(k, None if m is None else [float(v) for v in np.ravel(m)]) for k, (m, _) in cases.items()], "id string, matrix array<double>")
    marks = spark.createDataFrame([(k, *map(float, f), *map(float, v)) for k, (_, pairs) in cases.items() for f, v in pairs], MARKS)
    return {r.id: r for r in op.registrations(t, marks, ["id"], "matrix").collect()}


def mapped(points, turn=False):
    p = points[:, ::-1] if turn else points
    q = p @ MATRIX[:, :3].T + MATRIX[:, 3]
    return q[:, ::-1] if turn else q


def test_each_hypothesis_is_found(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(6, 3)) * 50
    noise = rng.normal(size=(6, 3)) * 0.1
    cases = {}
    for turn in (False, True):
        q = mapped(p, turn) + noise
        cases[f"moving_to_fixed {'zyx' if turn else 'xyz'}"] = (MATRIX, list(zip(q, p, strict=True)))
        cases[f"fixed_to_moving {'zyx' if turn else 'xyz'}"] = (MATRIX, list(zip(p, q, strict=True)))
    got = registered(spark, cases)
    far = np.linalg.norm(noise, axis=1)
    assert set(got) == set(cases)
    for k, r in got.items():
        assert (r.status, f"{r.direction} {r.axes}", r.landmarks) == ("accepted", k, 6)
        assert (r["mean"], r.worst) == (pytest.approx(far.mean()), pytest.approx(far.max())) and r.runner_up > 5 * r["mean"]


def test_refusals(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(5, 3)) * 50
    fit = list(zip(mapped(p), p, strict=True))
    nan = MATRIX.copy()
    nan[0, 3] = np.nan
    got = registered(spark, {
        "few": (MATRIX, fit[:3]), "none": (MATRIX, []), "null": (None, fit), "short": (MATRIX[:2], fit), "nan": (nan, fit), "flat": (np.zeros((3, 4)), fit),
        "lost": (MATRIX, [*fit[:4], ([np.inf, 0, 0], p[0])]), "unsure": (MATRIX, list(zip(rng.normal(size=(5, 3)) * 50, p, strict=True))),
    })
    assert {k: r.status for k, r in got.items()} == {"few": "few_landmarks", "none": "few_landmarks", "null": "malformed", "short": "malformed", "nan": "not_finite", "flat": "singular", "lost": "not_finite", "unsure": "ambiguous"}
    assert all((r.direction is None) == (k != "unsure") for k, r in got.items())


SHA = hashlib.sha256(b"w").hexdigest()
TABLES = {
    "releases": "release string, final string, pseudo boolean, data_license string",
    "checkpoints": "release string, id string, role string, parents array<string>, data array<string>, license string, sha256 string",
    "datasets": "release string, id string, role string, producer string, license string",
    "runs": "release string, id string, kind string, checkpoint string, stochastic boolean, seed long, public boolean",
    "held": "release string, id string, sha256 string",
}


def whole():
    """A release of a producer, its pseudo-labels and the final checkpoint trained on them."""
    return {
        "releases": [["r", "f", True, "open"]],
        "checkpoints": [["r", "p", "producer", None, ["raw"], "open", SHA], ["r", "f", "final", ["p"], ["raw", "made"], "open", SHA]],
        "datasets": [["r", "raw", "source", None, "open"], ["r", "made", "pseudo-label", "p", "open"]],
        "runs": [["r", "1", "training", "p", True, 5, True], ["r", "2", "training", "f", False, None, True], ["r", "3", "inference", "p", False, None, True], ["r", "4", "inference", "f", False, None, True]],
        "held": [["r", "p", SHA], ["r", "f", SHA]],
    }


def found(spark, tables):
    out = op.release_findings(*[spark.createDataFrame(tables[k], s) for k, s in TABLES.items()])
    return sorted((r.code, r.subject) for r in out.collect())


CHANGES = [
    ("checkpoints", 1, 2, "producer", [("final_count", "0")]),
    ("checkpoints", 0, 2, "final", [("final_count", "2")]),
    ("releases", 0, 1, "p", [("final_count", "1")]),
    ("checkpoints", 1, 3, ["p", "gone"], [("unknown_parent", "f>gone")]),
    ("checkpoints", 1, 3, ["f"], [("self_parent", "f")]),
    ("checkpoints", 1, 4, ["raw", "gone"], [("unknown_data", "f>gone")]),
    ("datasets", 1, 3, "gone", [("unknown_producer", "made>gone")]),
    ("datasets", 1, 3, None, [("no_producer", "made")]),
    ("datasets", 0, 3, "p", [("producer_not_allowed", "raw")]),
    ("datasets", 1, 2, None, [("producer_not_allowed", "made"), ("pseudo_missing", None)]),
    ("releases", 0, 2, False, [("pseudo_undeclared", None)]),
    ("runs", 1, 3, "p", [("no_training", "f")]),
    ("runs", 3, 2, "training", [("no_inference", "f")]),
    ("runs", 2, 3, "gone", [("no_inference", "p"), ("unknown_checkpoint", "3>gone")]),
    ("runs", 0, 5, None, [("no_seed", "1")]),
    ("runs", 1, 4, None, [("no_seed", "2")]),
    ("runs", 1, 6, None, [("not_public", "2")]),
    ("checkpoints", 0, 5, "by", [("license", "p")]),
    ("datasets", 0, 4, None, [("license", "raw")]),
    ("checkpoints", 0, 6, "abc", [("digest", "p")]),
    ("held", 0, 1, "q", [("not_held", "p")]),
    ("held", 1, 2, "0" * 64, [("held_differs", "f")]),
    ("runs", 1, 1, "1", [("duplicate_id", "run 1")]),
]


def test_each_fault_alone(spark):
    """Every change makes a release of its own; all are audited at once."""
    tables = {k: [] for k in TABLES}
    for n in range(len(CHANGES) + 1):
        one = whole()
        if n < len(CHANGES):
            table, row, column, value, _ = CHANGES[n]
            one[table][row][column] = value
        for k, rows in one.items():
            tables[k] += [[f"r{n:02d}", *r[1:]] for r in rows]
    out = op.release_findings(*[spark.createDataFrame(tables[k], s) for k, s in TABLES.items()]).collect()
    for n, (*_, want) in enumerate(CHANGES):
        assert sorted(((r.code, r.subject) for r in out if r.release == f"r{n:02d}"), key=str) == sorted(want, key=str), n
    assert not [r for r in out if r.release == f"r{len(CHANGES):02d}"]


def test_no_releases(spark):
    assert found(spark, {k: [] for k in TABLES}) == []
