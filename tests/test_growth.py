"""Steps that grew faster than their input: the same rows as loops, and the plan or the work that keeps them bounded."""

import math
import random
import re

import duckdb
import pytest
from plumbline import catalog
from plumbline.operators import ensembles, graphs, rules, sampling, spatial, surfaces, trees, vectors
from plumbline.sources import files
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_is_never_broadcast(spark):
    """Each side is large once it is shown to cells around it, whatever Spark believes of the table."""
    rng = random.Random(3)
    rows = [("ab"[k % 2], k, *(rng.uniform(-9, 9) for _ in "xyz")) for k in range(300)] + [("a", 900, 4.0, 0.0, 0.0), ("b", 901, 0.0, 0.0, 0.0), ("b", 902, None, 0.0, 0.0)]
    got = spatial.within_radius(spark.createDataFrame(rows, "f string, id long, x double, y double, z double"), "f", "id", ["x", "y", "z"], 4.0)
    assert "Broadcast" not in plan(got)
    good = [r for r in rows if r[2] is not None]
    want = {(p[1], q[1]) for p in good for q in good if p[1] < q[1] and p[0] != q[0] and sum((a - b) ** 2 for a, b in zip(p[2:], q[2:], strict=True)) <= 16}
    pairs = [(r.id1, r.id2) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want and (900, 901) in want


def boxed(rng, n):
    """Few different boxes, many of each."""
    return [(k, "uv"[k % 2], x, x + 3, y, y + rng.choice([2, 4])) for k in range(n) for x, y in ((rng.randint(0, 4), rng.randint(0, 9)),)]


BOX = "id long, volume string, x0 int, x1 int, y0 int, y1 int"


def test_points_meet_equal_boxes_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LIST", 4)
    monkeypatch.setattr(spatial, "TASK_ROWS", 50)
    rng = random.Random(5)
    boxes = [*boxed(rng, 200), (900, None, None, 3, 1, 2), (None, "u", 0, 3, 0, 4)]
    points = [(k, rng.uniform(-1, 9), rng.uniform(-1, 15)) for k in range(150)] + [(800, -0.5, 0.0), (801, None, 0.0)]
    got = spatial.points_in_boxes(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(boxes, BOX).withColumnRenamed("id", "box"), ["x", "y"], "point", "box", 0.5, 5.0)
    want = sorted((str(p), str(b)) for p, x, y in points for b, _, x0, x1, y0, y1 in boxes if None not in (x, x0) and x0 - 0.5 <= x <= x1 + 0.5 and y0 - 0.5 <= y <= y1 + 0.5)
    assert sorted((str(r.point), str(r.box)) for r in got.collect()) == want
    assert "__ids" in plan(got)  # the last join is of lists, not of boxes


def test_box_overlaps_measure_equal_boxes_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LIST", 4)
    monkeypatch.setattr(spatial, "TASK_ROWS", 50)
    rng = random.Random(6)
    a, b = boxed(rng, 150), [*boxed(rng, 150), (900, None, 0, 3, 0, 3), (None, "u", 0, 3, 0, 4)]
    got = spatial.box_overlaps(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), "volume", ["y", "x"], "id", 3)
    want = sorted((v, str(p), str(q), w * h) for p, v, x0, x1, y0, y1 in a for q, u, s0, s1, t0, t1 in b if u == v for w, h in ((min(x1, s1) - max(x0, s0), min(y1, t1) - max(y0, t0)),) if w > 0 and h > 0)
    assert sorted((r.volume, str(r.id_a), str(r.id_b), r.overlap) for r in got.collect()) == want
    assert "__ids_a" in plan(got)


def sides(spark, folder, name, table, rows, schema):
    """A query's rows and its SQL's, over one table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    got = con.execute(catalog.oracle_sql()[name])
    at = [c[0] for c in got.description]
    return sorted((tuple(r[c] for c in at) for r in df.collect()), key=repr), sorted(got.fetchall(), key=repr)


def test_logarithm_of_zero_is_null_in_both(spark, tmp_path):
    rows = [(1, 0.0), (2, 10.0), (3, None), (4, 0.25)]
    have, want = sides(spark, tmp_path, "f08_numeric", "events", rows, "event_id long, value double")
    assert have == want and next(r[-1] for r in have if r[0] == 1) is None


def test_mean_at_its_limit_is_not_over_it(spark, tmp_path):
    rng, rows = random.Random(9), []
    for k in range(30):  # 600 discounts whose mean is 0.0505, in any order
        d = [0.05] * 200 + [0.06] * 130 + [0.04] * 130 + [0.1] * 6 + [0.05] * 134
        assert len(d) == 600 and sum(round(100 * x) for x in d) == 3030
        rng.shuffle(d)
        rows += [(k, 30.0, x, 0.0) for x in d]
    have, want = sides(spark, tmp_path, "r05_health_verdict", "lineitem", rows, "l_suppkey long, l_quantity double, l_discount double, l_tax double")
    assert have == want and {v for _, v in have} == {"TRAIN"}


def test_vectors_are_sent_once_for_each_lot(spark, monkeypatch):
    """Without structure every cell is asked for; rows that are sent do not grow with the cells."""
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng, sent = random.Random(2), []
    rows = [(0, k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(400)]
    kept = vectors.settled
    monkeypatch.setattr(vectors, "settled", lambda df: sent.append(df) or kept(df))
    got = vectors.nearest_vectors(spark.createDataFrame(rows, "view int, item long, x array<double>"), ["view"], "item", "x").collect()
    asked = [df for df in sent if "slots" in df.columns]
    assert asked and asked[0].count() <= 8 * 400 < sum(r.opened for r in got) / 2


def test_average_ranks_sort_no_group_in_one_task(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -0.0, float("nan"), *range(9)]), k) for k in range(300)]
    rows = [(g, None if v is None else float(v), k) for g, v, k in rows]
    got = {r.k: r.rank for r in sampling.average_rank(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v").collect()}
    order = lambda v: (v is not None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v + 0.0)
    for g, v, k in rows:
        mine = [order(w) for h, w, _ in rows if h == g]
        assert got[k] == sum(w < order(v) for w in mine) + (sum(w == order(v) for w in mine) + 1) / 2
    df = sampling.average_rank(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v")
    assert not [w for w in re.findall(r"windowspecdefinition\((.*?)\)", plan(df)) if "__v" in w and "__p" not in w]
    assert len(got) == 300 and "rank(v" not in plan(df)


def test_pairs_of_a_large_group_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TASK_PAIRS", 100)
    rows = [("a", k, k * 0.5) for k in range(60)] + [("b", k, 1.0) for k in range(5)] + [(None, 99, 1.0), ("a", 7, 9.0)]
    got = sampling.pairs_within(spark.createDataFrame(rows, "g string, k long, v double"), "g", "k")
    want = sorted((g, x, y, v, w) for g, x, v in rows for h, y, w in rows if g is not None and g == h and x < y)
    assert sorted((r.g1, r.k1, r.k2, r.v1, r.v2) for r in got.collect()) == want
    most = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert max(most) < len(want) / 4


def sized(df) -> bool:
    """Whether the size that Spark expects has fewer than 60 digits; planning a loop whose sizes multiply takes longer than its work."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**60


@pytest.fixture(scope="module")
def path(spark):
    """A path of shuffled names, a few edges of it twice."""
    rng, names = random.Random(8), list(range(64))
    rng.shuffle(names)
    return spark.createDataFrame([(k, names[k], names[k + 1], 1, float(k % 5)) for k in range(63)] + [(100 + k, names[k], names[k + 1], 1, 9.0) for k in (3, 7)], "eid long, i long, j long, d long, w double")


def test_sizes_do_not_multiply_over_rounds_of_components(spark, path):
    got = graphs.components(path, "i", "j")
    assert sized(got) and {r.component for r in got.collect()} == {0} and got.count() == 64
    texts = path.selectExpr("'n' || i AS i", "'n' || j AS j")
    got = graphs.components(texts, "i", "j")
    assert sized(got) and {r.component for r in got.collect()} == {"n0"} and got.count() == 64


def test_dense_graph_is_contracted_before_it_is_starred(spark, monkeypatch):
    rng, starred = random.Random(3), []
    rows = [(100 * c + rng.randrange(30), 100 * c + rng.randrange(30)) for c in range(3) for _ in range(400)]
    kept = graphs._starred
    monkeypatch.setattr(graphs, "_starred", lambda df, rounds: starred.append(df.count()) or kept(df, rounds))
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(rows, "i long, j long"), "i", "j").collect()}
    assert got == {n: min(m for r in rows for m in r if m // 100 == n // 100) for r in rows for n in r}
    assert max(starred) <= 90


def test_sizes_do_not_multiply_over_rounds_of_a_forest(spark, path):
    got = graphs.maximum_forest(path, "w")
    assert sized(got) and {r.eid for r in got.collect()} == {*range(63), 103, 107} - {3, 7}
    assert {r.eid for r in graphs.maximum_forest(path, None).collect()} == set(range(63))


def test_sizes_do_not_multiply_over_turns(spark):
    rows = [(2 * k if k % 2 else 2 * k + 2, 2 * k + 2 if k % 2 else 2 * k, 1) for k in range(24)]
    even = spark.createDataFrame([(f"s{i}", f"p{j}", d) for i, j, d in rows], "i string, j string, d long")
    got = trees.solved(even, "i", "j", "d")
    assert sized(got) and got.count() == 25


def test_sizes_do_not_multiply_over_levels(spark, path):
    assert sized(graphs.bfs_forest(path.where("eid < 24")))


def test_equal_places_are_asked_for_once(spark, monkeypatch):
    """Copies of the points with other ids add rows to the last join alone; what is not finite is not found and hides nothing."""
    rng, sent = random.Random(11), []
    kept = spatial.settled
    monkeypatch.setattr(spatial, "settled", lambda df: sent.append(kept(df)) or sent[-1])
    at = [("ab"[k % 2], round(rng.gauss(0, 3), 2), round(rng.gauss(0, 3), 2)) for k in range(300)]
    odd = [("a", float("nan"), 0.0), ("a", float("inf"), 0.0), ("a", -0.0, 0.0)]
    q = [(f, k + 1000 * c, x, y) for c in range(8) for k, (f, x, y) in enumerate(at + odd)]
    t = [(f, k + 1000 * c, x + 0.3, y) for c in range(8) for k, (f, x, y) in enumerate(at + odd)]
    got = spatial.nearest(spark.createDataFrame(q, "f string, q long, x double, y double"), spark.createDataFrame(t, "f string, t long, x double, y double"), ["f"], ["x", "y"], "q", "t", 2.0, 2.0, 8)
    have = {r.q: (r.d, r.t) for r in got.collect()}
    for f, k, *p in q[:303] + q[-3:]:
        near = [(round(math.dist(p, to), 9), i) for g, i, *to in t[:303] if g == f and all(map(math.isfinite, (*p, *to))) and math.dist(p, to) <= 2]
        assert have[k] == min(near, default=(None, None))
    assert len(have) == len(q) and max(df.count() for df in sent) < len(q)


def test_no_pair_of_members_moves(spark, monkeypatch):
    """Lists of partners are shuffled, and pairs are counted where they are spelt, in as many tasks as there are pairs for."""
    monkeypatch.setattr(ensembles, "TASK_PAIRS", 200)
    rng = random.Random(12)
    held = {m: {0, *rng.sample(range(1, 30), 6)} for m in range(80)}
    rows = spark.createDataFrame([(m, u) for m, us in held.items() for u in us], "m long, u long")
    got = ensembles.shared_units(rows, [], "m", "u", block=8)
    assert "Exchange" not in plan(got).split("explode(ys")[0]
    assert {(r.a, r.b): r.shared for r in got.collect()} == {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b}
    most = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(most) > 10 and max(most) < 80 * 79 // 2 / 4


def test_lines_of_a_mesh_are_numbered_by_stretches(spark, tmp_path, monkeypatch):
    """No task sorts a whole block of a file, and what it sorts has not been split into words yet."""
    monkeypatch.setattr(files, "LINES", 7)
    (tmp_path / "m.obj").write_text("".join(f"v {k} 0 0\n vt {k} 0\nv {k} 1 0\n\nv {k} 2 0\nf -3/-1 -2/{k + 1} -1\n" for k in range(40)))
    m = files.polygon_mesh(spark, str(tmp_path))
    sizes = [r["count"] for r in m["vertices"].groupBy(F.floor((F.col("vid") - 1) / 3)).count().collect()]
    assert sizes == [3] * 40 and [(r.vid, r.x, r.y) for r in m["vertices"].orderBy("vid").collect()] == [(3 * k + j + 1, float(k), float(j)) for k in range(40) for j in range(3)]
    want = [(6 * k + 6, 3 * k + 1, 3 * k + 2, 3 * k + 3, k + 1, k + 1, None) for k in range(40)]
    assert [tuple(r) for r in m["triangles"].orderBy("line").select("line", "v0", "v1", "v2", "t0", "t1", "t2").collect()] == want
    windows = re.findall(r"windowspecdefinition\((.*?)\)", plan(m["triangles"]))
    assert windows and all("stretch" in w for w in windows)


def test_dominators_are_counted_without_pairs(spark, monkeypatch):
    """Copies of rows are compared once, and two cells in parts."""
    monkeypatch.setattr(spatial, "TASK_ROWS", 20)
    rng, sent = random.Random(13), []
    kept = spatial.settled
    monkeypatch.setattr(spatial, "settled", lambda df: sent.append(kept(df)) or sent[-1])
    at = [(float(rng.randint(0, 8)), float(rng.randint(0, 8)), float(rng.choice([0, 1, 2, -0.0]))) for _ in range(60)]
    rows = [(100 * c + k, *p) for c in range(5) for k, p in enumerate(at)] + [(900, None, 1.0, 1.0)]
    got = spatial.dominated(spark.createDataFrame(rows, "k long, a double, b double, c double"), "k", ["a", "b"], ["c"], 27)
    beats = lambda p, q: p[0] >= q[0] and p[1] >= q[1] and p[2] <= q[2] and p != q
    want = {k: [j for j, *q in rows[:-1] if beats(q, p)] for k, *p in rows[:-1]}
    assert {r.k: (r.dominators, r.first, r.last) for r in got.collect()} == {k: (len(v), min(v, default=None), max(v, default=None)) for k, v in want.items()}
    assert sent[1].count() <= 60


def test_few_triangles_are_measured(spark, monkeypatch):
    """A point and a triangle meet once, and only triangles as near as the nearest corner are measured."""
    rng, calls = random.Random(14), spark.sparkContext.accumulator(0)
    kept = surfaces.triangle_distance
    told = F.udf(lambda fid: calls.add(1) or fid, "long")
    monkeypatch.setattr(surfaces, "triangle_distance", lambda *a: kept(*a) + 0.0 * told("fid"))
    at = lambda: [(x := rng.uniform(0, 200)), (y := rng.uniform(0, 200)), rng.uniform(0, 20)]  # noqa: E731, F841
    tri = [(k, *[v + rng.uniform(-5, 5) for _ in range(3) for v in p]) for k in range(800) for p in (at(),)] + [(9000, 100.0, 100.0, 5.0, *[None] * 6)]
    pts = [(k, *at()) for k in range(100)] + [(500, 900.0, 900.0, 0.0), (501, None, 1.0, 1.0)]
    names = ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz")
    got = surfaces.point_to_mesh(spark.createDataFrame(pts, "id long, x double, y double, z double"), spark.createDataFrame(tri, f"fid long, {names}"), "id", 20.0)
    have = {r.id: (r.fid, r.d) for r in got.collect()}
    assert calls.value < 100 * 800 * 0.04 and len(have) == 102 and have[500] == have[501] == (None, None)
    monkeypatch.undo()
    both = spark.createDataFrame(pts, "id long, x double, y double, z double").crossJoin(spark.createDataFrame(tri, f"fid long, {names}"))
    d = surfaces.triangle_distance(surfaces._p(), *[[F.col(k + a) for a in "xyz"] for k in "abc"])
    want = {r.id: r.b for r in both.withColumn("d", d).where("d <= 20").groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "fid")).alias("b")).collect()}
    assert {k: v for k, v in have.items() if v[0] is not None} == {k: (b.fid, b.d) for k, b in want.items()}


def test_units_are_gathered_by_their_rows_and_sent_by_blocks(spark, monkeypatch):
    """What a task gathers does not hang on the session's partitions; a unit of all members is sent once for each block, not once for each member."""
    monkeypatch.setattr(ensembles, "TASK_ROWS", 100, raising=False)
    rng, stored, moved = random.Random(15), [], []
    kept, dealt = ensembles.settled, ensembles._dealt
    monkeypatch.setattr(ensembles, "settled", lambda df: stored.append(kept(df)) or stored[-1])
    monkeypatch.setattr(ensembles, "_dealt", lambda sent, *a: moved.append(sent) or dealt(sent, *a))
    held = {m: {0, *rng.sample(range(1, 200), 4), *([900] if m < 30 else [])} for m in range(400)}
    rows = [("a", m, u, 1 + u % 3) for m, us in held.items() for u in us] + [("b", m, 0, 2) for m in range(3)] + [(None, 1, 0, 2), (None, 2, 0, 2), ("b", 1, 0, 5)]
    got = ensembles.shared_units(spark.createDataFrame(rows, "g string, m long, u long, w long"), ["g"], "m", "u", "w", block=8)
    lists = next(df for df in stored if "ms" in df.columns)
    assert lists.rdd.getNumPartitions() >= len(rows) // 100 > 4
    sparse = sum(n * (n - 1) for n in (sum(u in us for us in held.values()) for u in [*range(1, 200), 900]))
    ids = moved[0].select(*[F.sum(F.size(c)) for c in ("xs", "ys")]).first()
    assert sum(ids) <= sparse + 2 * 400 * 21 < 400 * 399 // 2
    want = {("a", a, b): (len(both), float(sum(1 + u % 3 for u in both))) for a in held for b in held if a < b for both in (held[a] & held[b],)}
    assert {(r.g, r.a, r.b): (r.shared, r.weight) for r in got.collect()} == want | {("b", a, b): (1, 5.0) for a, b in ((0, 1), (0, 2), (1, 2))}


def test_no_fact_is_joined_to_pairs(spark, monkeypatch):
    """Each pair's facts come with its two blocks; blocks and lone pairs say the same as one block."""
    rng = random.Random(16)
    maybe = lambda v: None if rng.random() < 0.2 else v
    members = [("ab"[m % 9 == 0], m, maybe(f"c{m // 2}" if m < 20 else f"c{m}"), maybe([f"base{m % 5}"] if m % 3 else []), maybe(m % 4), maybe(m % 7), maybe("kl"[m % 2])) for m in range(90)]
    units = [(g, m, u, float(u % 3)) for g, m, *_ in members if m % 11 for u in [0, *rng.sample(range(1, 30), 3)]] + [("a", 500, 0, 0.0), (None, 1, 0, 1.0)]
    m = spark.createDataFrame(members, "g string, m long, checkpoint string, parents array<string>, init_seed int, order_seed int, config string")
    u = spark.createDataFrame(units, "g string, m long, u long, w double")
    one = ensembles.independence(m, u, ["g"], "m", "u", "w", 0.3)
    above = plan(one).split("explode(ys")[0]
    assert "Join" not in above and "Exchange" not in above
    whole = sorted(one.collect())
    monkeypatch.setattr(ensembles, "BLOCK", 8)
    monkeypatch.setattr(ensembles, "FEW", 3)
    assert sorted(ensembles.independence(m, u, ["g"], "m", "u", "w", 0.3).collect()) == whole
    by = {r.m: r for r in m.collect()}
    held = {r[0]: {x[2] for x in units if x[:2] == (by[r[0]].g, r[0])} for r in ((k,) for k in by)}
    assert len(whole) == sum(by[a].g == by[b].g for a in by for b in by if a < b)
    for r in whole:
        a, b, both = by[r.a], by[r.b], held[r.a] & held[r.b]
        assert r.shared == len(both) and r.identical == (a.checkpoint is not None and a.checkpoint == b.checkpoint)
        assert r.order == ("unknown" if None in (a.order_seed, b.order_seed) else "shared" if a.order_seed == b.order_seed else "distinct")
        least = min(sum(x % 3 for x in held[k]) for k in (r.a, r.b))
        assert (r.overlap is None) == (not held[r.a] or not held[r.b] or not least) and (r.overlap is None or r.overlap == pytest.approx(sum(x % 3 for x in both) / least))


def test_percentiles_of_a_frame_are_not_one_tasks(spark, monkeypatch):
    """Distances are measured once for each side, and a frame's percentiles gather no map of its values."""
    rng, calls = random.Random(17), []
    kept = spatial.nearest
    monkeypatch.setattr(spatial, "nearest", lambda *a: calls.append(kept(*a)) or calls[-1])
    rows = [("ab"[k % 3 == 0], k, rng.gauss(0, 4), rng.gauss(0, 4), k % 5) for k in range(240)] + [("c", 900, 0.0, 0.0, 1), ("c", 901, 50.0, 0.0, 1)]
    p = spark.createDataFrame(rows, "frame string, id long, x double, y double, w int")
    got = spatial.surface_recovery(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["frame"], ["x", "y"], 0.5, 2.0, "w")
    assert "percentile" not in plan(got) and len(calls) == 2
    have = {r.frame: r for r in got.collect()}
    for name, d in zip(("truth", "found"), calls, strict=True):
        for r in d.groupBy("frame").agg(F.percentile("d", F.array(*map(F.lit, (0.5, 0.95, 1.0)))).alias("q"), F.count_if(F.col("d").isNull()).alias("beyond")).collect():
            q = [have[r.frame][f"{name}_{c}"] for c in ("p50", "p95", "max")]
            assert have[r.frame][f"{name}_beyond"] == r.beyond and q == (pytest.approx(r.q, abs=1e-12) if r.q else [None] * 3)
    assert set(have) == {"a", "b", "c"} and have["c"].truth_p50 is None


def test_anchor_hung_from_wrong_readings_is_corrected(spark, tmp_path):
    """The heaviest pair hangs p1 from s0 by readings that are one off; the others outvote them, though p1 is what all values are told from."""
    rows = [(s, p, 1, 10.0) for s in range(4) for p in range(6) for _ in range(2) if (s, p) != (0, 1)] + [(0, 1, 7, 10.0)] * 3 + [(2, 4, 1, 50.0)]
    have, want = sides(spark, tmp_path, "g07_solved_residuals", "lineitem", rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double")
    assert have == want and have[0][:4] == (50, 46, 3, 1)
    readings = spark.createDataFrame([(f"s{s}", f"p{p}", p - s + (n == 7)) for s, p, n, _ in rows], "i string, j string, d long")
    got = {r.node: (r.val, r.anchored) for r in trees.solved(readings, "i", "j", "d", "p1", pinned=False).collect()}
    assert got["p1"] == (0, True) and got["s0"] == (-1, False) and got["p5"] == (4, False)


def test_units_of_neighbours_move_once(spark, monkeypatch):
    """Copies of an ensemble with shifted members and units: what moves follows the copies, and pairs are neither moved nor met by a loop."""
    monkeypatch.setattr(ensembles, "BLOCK", 8)
    rng, moved = random.Random(18), []
    dealt = ensembles._dealt
    monkeypatch.setattr(ensembles, "_dealt", lambda sent, *a: moved.append(sent) or dealt(sent, *a))
    held = {40 * c + m: {1000 * c + u for u in us} for m in range(40) for us in (rng.sample(range(60), 20),) for c in range(12)}
    held |= {900: {77777}, 901: {88888, 3}, 902: {88888}}
    rows = [(m, u) for m, us in held.items() for u in us] + [(0, u) for u in held[0]] + [(None, 3), (5, None)]
    rng.shuffle(rows)
    got = rules.overlap_audit(spark.createDataFrame(rows, "m long, u long"), "m", "u")
    assert not re.search("NestedLoop|Cartesian|SortMergeJoin", plan(got)) and "Exchange" not in plan(got).split("explode(ys")[0].replace("BroadcastExchange", "")
    want = {(a, b): (len(both), len(both) / min(len(x), len(y)), len(both) / len(x | y)) for a, x in held.items() for b, y in held.items() if a < b for both in (x & y,) if both}
    have = got.collect()
    assert len(have) == len(want) and {(r.a, r.b): (r.common, r.overlap, r.jaccard) for r in have} == want
    ids, lists = moved[0].select(F.sum(F.size("xs") + F.size("ys")), F.count("*")).first()
    assert lists < sum(map(len, held.values())) and ids < sum(c for c, *_ in want.values())


def test_lists_of_points_meet_lists_of_boxes(spark, monkeypatch):
    """What moves for the pairs are two ids for each LIST of them, and what is written on the way follows the input."""
    monkeypatch.setattr(spatial, "LIST", 16)
    monkeypatch.setattr(spatial, "TASK_ROWS", 500)
    boxes = spark.range(240).selectExpr("id AS box", "0 AS x0", "3 AS x1", "0 AS y0", "4 AS y1")
    points = spark.range(300).selectExpr("id AS point", "1.0D + id / 1000 AS x", "2.0D AS y")
    moved = []
    kept = spatial._spelt
    monkeypatch.setattr(spatial, "_spelt", lambda met, *a: moved.append(met) or kept(met, *a))
    got = spatial.points_in_boxes(points, boxes, ["x", "y"], "point", "box", 0.5, 5.0)
    assert got.count() == got.distinct().count() == 300 * 240 and moved[0].rdd.getNumPartitions() == 144
    assert moved[0].select(F.sum(F.size("__ids_p") + F.size("__ids_b"))).first()[0] < 300 * 240 / 4


def test_rows_that_make_pairs_are_short(spark, monkeypatch):
    """All that one row makes is held before it goes on: no row makes more than SPELT x SPELT pairs, and NULL ids are kept."""
    df = spark.createDataFrame([("u", [*range(70)], [None, *range(100)]), ("v", [1], [2])], "v string, a array<long>, b array<long>")
    got = spatial._spelt(df, ["v"], "a", "b")
    want = [("u", p, q) for p in range(70) for q in (None, *range(100))] + [("v", 1, 2)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert plan(got).count("Generate") == 4 and plan(got).count("slice(") >= 2


def test_edges_are_made_once_for_all_turns(spark):
    """Turns read the edges as a table, and move as loops do: a winner stays, else the least of the winners."""
    rng, calls = random.Random(19), spark.sparkContext.accumulator(0)
    rows = [(f"a{rng.randrange(12)}", f"b{rng.randrange(15)}", rng.randint(-3, 3), rng.choice([1, 1, 2])) for _ in range(150)]
    told = F.udf(lambda d: calls.add(1) or d, "long")
    edges = spark.createDataFrame(rows, "i string, j string, d long, w long").withColumn("d", told("d"))
    val = {n: rng.randint(-2, 2) for r in rows for n in r[:2]} | {"alone": 7}
    got = graphs.mode_refined(edges, spark.createDataFrame([*val.items()], "node string, val long"))
    have, turns = {r.node: r.val for r in got.collect()}, 0
    while True:
        before, turns = dict(val), turns + 1
        for side in (0, 1):
            new = dict(val)
            for n in val:
                votes = {}
                for r in rows:
                    if r[side] == n:
                        x = val[r[1 - side]] + (r[2] if side else -r[2])
                        votes[x] = votes.get(x, 0) + r[3]
                most = [x for x, k in votes.items() if k == max(votes.values())]
                new[n] = val[n] if not most or val[n] in most else min(most)
            val = new
        if val == before:
            break
    assert have == val and turns > 1 and calls.value == len(rows)


def test_a_vector_is_measured_once(spark):
    """Its length is not made anew for each of its numbers; what has no direction is NULL."""
    rows = [[3.0, 4.0], [0.0, 0.0], [1.0, None], [float("inf"), 1.0], [float("nan"), 1.0], None]
    got = spark.createDataFrame([(x,) for x in rows], "x array<double>").select(vectors.unit("x").alias("u")).collect()
    assert [r.u for r in got] == [[0.6, 0.8], *[None] * 5]
    one = spark.createDataFrame([([1.0] * 64,)], "x array<double>").select(vectors.unit("x").alias("u"))
    inner = plan(one).split("transform(array(")
    assert len(inner) == 3 and all("sqrt" not in part.rsplit(" / ", 1)[-1].split(",")[0] for part in inner)
    assert one.first().u == [0.125] * 64
