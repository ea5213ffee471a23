"""Reviews, reruns, gauges and preflights on small tables made by hand."""

from plumbline.operators import reviews as op


def test_a_batch_is_refused_for_any_violation(spark):
    kind = "k long, v long, x double"
    original = [(1, 5, 0.5), (2, 6, 1.0), (3, None, 1.5), (4, 8, None)]
    good = [(1, 7, 0.5, "annotation_corrected"), (2, 6, 1.0 + 1e-9, "no_issue"), (3, None, 1.5, "uncertain"), (4, 8, None, "patch_issue")]

    def run(rows, base=original):
        got = op.review_ingest(spark.createDataFrame(base, kind), spark.createDataFrame(rows, f"{kind}, d string"), ["k"], "v", ["x"], "d")
        return got["verdict"].first(), {r.k: r.reasons for r in got["ledger"].collect()}

    v, why = run(good)
    assert v.accepted and v.targets == 4 and v.annotation_corrected == 1 and not any(why.values())
    v, why = run([(1, 5, 0.5, "annotation_corrected"), (2, 7, 1.0, "no_issue"), (3, None, 1.6, "uncertain"), (5, 1, 1.0, None), (5, 1, 1.0, None)])
    assert not v.accepted and why == {1: ["not_changed"], 2: ["changed"], 3: ["moved"], 4: ["not_reviewed"], 5: ["repeated", "not_in_original", "no_decision"]}
    assert not run([], [])[0].accepted


def test_reruns_differ_only_as_declared(spark):
    df = lambda rows: spark.createDataFrame(rows, "k long, v double")
    before, after = [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None), (6, 6.0)], [(1, 1.0), (2, 2.5), (3, 3.5), (4, 4.0), (5, None), (7, 7.0)]
    got = {r.k: (r.delta, r.reasons) for r in op.rerun_comparison(df(before), df(after), df([(2, 2.5), (4, 4.5), (8, 1.0), (1, 1.0)]), ["k"], "v").collect()}
    assert got[2] == (0.5, []) and got[3] == (0.5, ["undeclared_change"]) and got[4] == (0.0, ["not_applied"]) and got[5] == (None, [])
    assert got[1][1] == ["no_correction"] and got[6][1] == ["only_before"] and got[7][1] == ["only_after"] and got[8][1] == ["correction_of_nothing"]
    near = {r.k: r.reasons for r in op.rerun_comparison(df(before), df(after), df([]), ["k"], "v", tolerance=0.6).collect()}
    assert near[2] == near[3] == []
    sides = {r.k: (r.side, r.v_delta) for r in op.target_deltas(df(before), df(after), "k", ["v"]).collect()}
    assert sides[2] == ("both", 0.5) and sides[6] == ("before", None) and sides[7] == ("after", None)


def test_nearest_winding_ties(spark):
    s = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "s long, e long")
    d = spark.createDataFrame([(1, 9, 2.0), (1, 11, 2.0), (1, 10, 3.0), (2, 12, 1.0), (2, 10, 1.0), (3, 13, 0.1), (3, 10, None)], "s long, w long, d double")
    assert {r.s: (r.delta, r.d) for r in op.winding_neighbours(s, d, "s", "e", "w", "d").collect()} == {1: (-1, 2.0), 2: (0, 1.0), 3: (None, None), 4: (None, None)}


def test_gauges_look_truth_up_either_way(spark):
    truth = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("e", "d", -4)], "a string, b string, d long")
    rows = [("p", "a", "b", 1), ("p", "c", "b", -2), ("p", "d", "c", -3), ("p", "d", "e", 4), ("q", "a", "b", 2), ("q", "b", "a", -2), ("q", "x", "y", 1), ("q", "c", "b", -5), ("r", "x", "y", 1)]
    got = {r.p: r for r in op.producer_gauge(truth, spark.createDataFrame(rows, "p string, a string, b string, d long"), "p", "a", "b", "d", 0.75, 0.5).collect()}
    assert (got["p"].exact, got["p"].coverage, got["p"].admissible, got["p"].unknown) == (1.0, 1.0, True, 0)
    assert (got["q"].answered, got["q"].unknown, got["q"].repeated, got["q"].exact, got["q"].within_one, got["q"].mean, got["q"].median, got["q"].admissible) == (2, 1, 1, 0.0, 0.5, 2.0, 2.0, False)
    assert (got["r"].answered, got["r"].exact, got["r"].admissible) == (0, None, False)


def test_preflight_gives_every_reason(spark):
    want = spark.createDataFrame([(k, "test", "c1") for k in range(1, 6)], "region long, split string, checkpoint string")
    sha = "0" * 64
    rows = [(1, "test", True, "none", "c1", True, sha), (2, "train", False, "some", "c2", False, "abc"), (3, None, None, None, None, None, None), (4, "test", True, "none", "c1", True, sha), (4, "test", True, "none", "c1", True, sha), (9, "test", True, "none", "c1", True, sha)]
    got = {r.region: (r.status, r.reasons) for r in op.region_preflight(want, spark.createDataFrame(rows, "region long, split string, held_out boolean, overlap string, checkpoint string, ready boolean, digest string"), "region").collect()}
    every = ["wrong_split", "not_held_out", "overlap", "wrong_checkpoint", "not_ready", "no_digest"]
    assert got == {1: ("ready", []), 2: ("failed", every), 3: ("failed", every), 4: ("failed", ["repeated"]), 5: ("failed", ["no_report"]), 9: ("failed", ["not_expected"])}


def test_drift_tells_fields_beyond_the_tolerance(spark):
    kind = "k long, px double, name string"
    left = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "a"), (3, None, None), (4, 1.0, "a")], kind)
    right = spark.createDataFrame([(1, 1.0 + 1e-9, "a"), (2, 1.1, None), (3, None, None), (5, 1.0, "a")], kind)
    got = sorted((r.k, r.field) for r in op.manifest_drift(left, right, "k", ["px"], ["name"]).collect())
    assert got == [(2, "name"), (2, "px"), (4, "only_left"), (5, "only_right")]
