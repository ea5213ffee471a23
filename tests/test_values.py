"""Values of the queries that SQL does not express, against loops over the same rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from plumbline import catalog
from plumbline.catalog import graphs
from plumbline.catalog.fixtures import grid, table
from plumbline.operators import graphs as graph_op
from plumbline.operators import trees
from plumbline.operators import spatial, surfaces, voxels
from plumbline.sources import files
from xxhash import xxh64_intdigest

DATA = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def cells_of(spark):
    return {(r.surface, r.row, r.col): r for r in grid(spark, DATA).collect()}


def pieces(cells, diagonal=False):
    """Connected sets of (surface, row, col)."""
    left, out = set(cells), []
    while left:
        heap = [left.pop()]
        piece = set(heap)
        while heap:
            s, r, c = heap.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if (diagonal or not (dr and dc)) and (n := (s, r + dr, c + dc)) in left:
                        left.remove(n)
                        piece.add(n)
                        heap.append(n)
        out.append(piece)
    return out


def test_geometry_digest(spark):
    want = {}
    blocks = defaultdict(list)
    for (s, r, c), x in cells_of(spark).items():
        blocks[s, r // 64].append((r, c, ",".join([str(r), str(c), str(x.valid).lower(), *([f"{v:,.6f}" for v in (x.x, x.y, x.z)] if x.valid else [])])))
    for s in {s for s, _ in blocks}:
        parts = [hashlib.sha256(";".join(t for _, _, t in sorted(rows)).encode()).hexdigest() for (k, _), rows in sorted(blocks.items()) if k == s]
        want[s] = hashlib.sha256("".join(parts).encode()).hexdigest()
    assert {r.surface: r.sha for r in run(spark, "s14_geometry_digest")} == want


def test_betti_numbers(spark):
    cells = cells_of(spark)
    got = {(r.surface, r.t): (r.b0, r.b1) for r in run(spark, "a48_betti_numbers")}
    want = {}
    for t in (0.3, 0.6, 0.9):
        kept = {k for k, x in cells.items() if x.p >= t}
        for s in {k[0] for k in kept}:
            own = {k for k in kept if k[0] == s}
            r1, c1 = max(k[1] for k in own) + 1, max(k[2] for k in own) + 1
            rest = {(s, r, c) for r in range(-1, r1 + 1) for c in range(-1, c1 + 1)} - own
            want[s, t] = len(pieces(own, True)), len(pieces(rest)) - 1
    assert got == want


def test_threshold_lineage(spark):
    cells = cells_of(spark)
    peak = lambda p: max(p, key=lambda k: (cells[k].p, -k[1], -k[2]))
    at = {t: {k: p for p in pieces({k for k, x in cells.items() if x.p >= t}) for k in p} for t in (0.75, 0.65, 0.55)}
    peaks = {peak(p) for p in at[0.75].values()}
    want = {}
    for k in peaks:
        above = None
        for t in (0.75, 0.65, 0.55):
            p = at[t][k]
            cy, cx = np.mean([x[1] for x in p]), np.mean([x[2] for x in p])
            want[(*k, t)] = (len(p), peak(p) != k, above and len(p) / above[0], above and math.hypot(cy - above[1], cx - above[2]))
            above = len(p), cy, cx
    got = {(r.surface, r.row, r.col, r.t): (r.area, r.taken_over, r.growth, r.drift) for r in run(spark, "a49_threshold_lineage")}
    assert got.keys() == want.keys() and any(v[1] for v in want.values())
    for k, v in want.items():
        assert got[k][:2] == v[:2] and got[k][2:] == (pytest.approx(v[2]), pytest.approx(v[3], abs=1e-9))


def test_patch_metrics(spark):
    cells = cells_of(spark)
    for g in run(spark, "a77_patch_metrics"):
        own = {k: x for k, x in cells.items() if k[0] == g.surface}
        valid = {k for k, x in own.items() if x.valid}
        r0, r1, c0, c1 = (f(k[i] for k in own) for i, f in ((1, min), (1, max), (2, min), (2, max)))
        holes = [p for p in pieces(set(own) - valid, True) if not any(k[1] in (r0, r1) or k[2] in (c0, c1) for k in p)]
        edges = [math.dist(*[(own[q].x, own[q].y, own[q].z) for q in (k, n)]) for k in valid for n in ((k[0], k[1] + 1, k[2]), (k[0], k[1], k[2] + 1)) if n in valid]
        assert (g.components, g.holes) == (len(pieces(valid)), len(holes)) and g.valid == pytest.approx(len(valid) / len(own))
        assert (g.p50, g.p99) == (pytest.approx(np.percentile(edges, 50)), pytest.approx(np.percentile(edges, 99)))
        assert g.support == pytest.approx(np.mean([own[k].p for k in valid])) and g.low_support == pytest.approx(np.mean([own[k].p < 0.1 for k in valid]))


def axial(a, b):
    d = (a - b) % 180
    return min(d, 180 - d)


def two_axes(rows):
    """rows: (place, angle, weight), one at a time; None where a group abstains."""
    rows = [(p, a % 180, w) for p, a, w in sorted(rows)]
    first = max(rows, key=lambda r: r[2])
    second = max(rows, key=lambda r: axial(r[1], first[1]) * r[2])
    if max(axial(r[1], first[1]) for r in rows) <= 0:
        return None
    centres = [first[1], second[1]]
    for _ in range(24):
        new = []
        for k in (0, 1):
            z = sum((w * complex(math.cos(math.radians(2 * a)), math.sin(math.radians(2 * a))) for _, a, w in rows if (axial(a, centres[0]) > axial(a, centres[1])) == k), 0j)
            if abs(z) <= 1e-15:
                return None
            new.append(math.degrees(math.atan2(z.imag, z.real)) / 2 % 180)
        moved, centres = max(map(axial, centres, new)), new
        if moved < 1e-7:
            break
    weight = [sum(w for _, a, w in rows if (axial(a, centres[0]) > axial(a, centres[1])) == k) for k in (0, 1)]
    return sorted(zip(centres, weight, strict=True))


def test_two_axes_go_on_until_they_stand(spark):
    """Groups that need many rounds, axes across the wrap, groups of one direction or one row."""
    rng = random.Random(4)
    rows = []
    for g in range(30):
        a, b = rng.uniform(0, 180), rng.uniform(0, 180)
        rows += [(g, k, rng.choice((a, b)) + rng.gauss(0, 30), rng.uniform(0.1, 5)) for k in range(60)]
    rows += [(100, k, 178.0 + k, 1.0 + k) for k in range(5)] + [(101, k, 40.0, 1.0) for k in range(4)] + [(102, 0, 7.0, 1.0)]
    got = {r.g: r for r in surfaces.two_axes(spark.createDataFrame(rows, "g int, k int, angle double, w double"), ["g"], ["k"], "angle", "w").collect()}
    for g in {r[0] for r in rows}:
        want = two_axes([r[1:] for r in rows if r[0] == g])
        if want is None:
            assert got[g].a is None and got[g].b is None
        else:
            assert (got[g].a, got[g].wa, got[g].b, got[g].wb) == pytest.approx((*want[0], *want[1]), abs=1e-6)


def test_axial_clusters_and_turns(spark):
    rows = defaultdict(list)
    for r in surfaces.tile_orientation(grid(spark, DATA), "z", 5).collect():
        if r.angle is not None and r.energy > 0:
            rows[r.surface, r.tr // 2, r.tc // 2].append(((r.tr, r.tc), r.angle, r.energy))
    want = {k: two_axes(v) for k, v in rows.items()}
    got = {(r.surface, r.tr, r.tc): r for r in run(spark, "a70_axial_clusters")}
    assert got.keys() == want.keys()
    for (s, r, c), axes in want.items():
        g = got[s, r, c]
        if axes is None:
            assert g.a is None
            continue
        assert (g.a, g.b) == pytest.approx((axes[0][0], axes[1][0]), abs=1e-6)
        turns = []
        for n in ((s, r, c + 1), (s, r + 1, c)):
            if want.get(n):
                p, q = [x[0] for x in axes], [x[0] for x in want[n]]
                turns.append(min(max(axial(p[0], q[0]), axial(p[1], q[1])), max(axial(p[0], q[1]), axial(p[1], q[0]))))
        assert g.discontinuity == (max(turns) > 30 if turns else None)


def test_leave_one_domain_out(spark):
    docs = table(spark, DATA, "documents").join(table(spark, DATA, "labels"), "doc_id").collect()
    rows = [(r.lang, float(r.quality), math.log1p(r.n_chars), sum(c in "!*#$%&|" for c in r.text or "") / max(1, len(r.text or ""))) for r in docs]
    lang, y, a, b = (np.array(c) for c in zip(*rows, strict=True))
    for got in run(spark, "a65_leave_one_domain_out"):
        x = np.stack((a, a * a), 1) if got.arm == "length" else np.stack((a, a * a, b, a * b, b * b), 1)
        train = lang != got.held
        scale = x[train].std(0, ddof=1)
        z = np.c_[np.where(scale > 0, x / np.where(scale > 0, scale, 1), 0), np.ones(len(x))]
        w = np.zeros(z.shape[1])
        ridge = 0.01 * np.r_[np.ones(len(scale)), 0]
        for _ in range(60):
            p = 1 / (1 + np.exp(-z[train] @ w))
            step = np.linalg.solve((z[train].T * (p * (1 - p))) @ z[train] / train.sum() + np.diag(ridge) + 1e-12 * np.eye(len(w)), z[train].T @ (p - y[train]) / train.sum() + ridge * w)
            w -= step
        s = 1 / (1 + np.exp(-z[~train] @ w))
        pos = np.sort(s[y[~train] == 1])[::-1]
        cut = pos[math.ceil(0.9 * len(pos)) - 1]
        assert got.cut == pytest.approx(cut, abs=2e-3)


def test_checkable_edges(spark):
    rows = graphs._sparse(spark, DATA).collect()
    near = defaultdict(set)
    for r in rows:
        near[r.i].add((r.j, r.eid))
        near[r.j].add((r.i, r.eid))

    def reached(start, without=None):
        seen, heap = {start}, [start]
        while heap:
            for n, e in near[heap.pop()]:
                if e != without and n not in seen:
                    seen.add(n)
                    heap.append(n)
        return seen

    low = {}
    for n in near:
        if n not in low:
            own = reached(n)
            low |= dict.fromkeys(own, min(own))
    got = {r.eid: r for r in run(spark, "g11_checkable_edges")}
    assert got.keys() == {r.eid for r in rows}
    for r in rows:
        bridge = r.j not in reached(r.i, r.eid)
        assert (got[r.eid].component, got[r.eid].bridge, got[r.eid].checkable) == (low[r.i], bridge, r.w >= 400000 or not bridge)


def test_solvers(spark):
    """Both solvers, an edge at a time."""
    e, _ = graphs._start(spark, DATA)
    rows = e.collect()
    signed = lambda x: x - 2**64 if x >> 63 else x
    eid = {(r.i, r.j): signed(xxh64_intdigest(r.j, xxh64_intdigest(r.i, 42))) for r in rows}
    near = defaultdict(list)
    for r in rows:
        near[r.i].append((r.j, eid[r.i, r.j], r.d))
        near[r.j].append((r.i, eid[r.i, r.j], -r.d))
    pot = {}
    for root in sorted(near):
        if root in pot:
            continue
        pot[root], front = 0, {root}
        while front:
            best = {}
            for n in front:
                for m, k, d in near[n]:
                    if m not in pot and (m not in best or (k, n) < best[m][:2]):
                        best[m] = k, n, pot[n] + d
            pot |= {m: v for m, (_, _, v) in best.items()}
            front = set(best)
    val = dict.fromkeys(near, 0)
    while True:
        before = dict(val)
        for own, other, sign in (("i", "j", -1), ("j", "i", 1)):
            votes = defaultdict(Counter)
            for r in rows:
                votes[r[own]][val[r[other]] + sign * r.d] += r.w
            for n, c in votes.items():
                top = [v for v, k in c.items() if k == max(c.values())]
                val[n] = val[n] if val[n] in top else min(top)
        if val == before:
            break
    exact = lambda v: np.mean([r.d == v[r.j] - v[r.i] for r in rows])
    assert {r.solver: r.exact for r in run(spark, "x04_solver_registry")} == pytest.approx({"bfs": exact(pot), "mode": exact(val)})


def test_refinement_does_not_end_early(spark):
    """A chain of 60 nodes that settles one node a round."""
    rows = [(f"s{k}", f"p{k}", 1, 5) for k in range(60)] + [(f"s{k + 1}", f"p{k}", 0, 9) for k in range(59)]
    e = spark.createDataFrame(rows, "i string, j string, d long, w long")
    v = e.select("i").union(e.select("j")).distinct().selectExpr("i AS node", "0L AS val")
    got = {r.node: r.val for r in graph_op.mode_refined(e, v).collect()}
    assert all(got[f"p{k}"] - got[f"s{k + 1}"] == 0 for k in range(59))
    with pytest.raises(RuntimeError):
        graph_op.mode_refined(e, v, rounds=0)


def test_polygon_of_many_corners(spark, tmp_path):
    """No corner is lost, two meshes keep their own numbers, texture vertices are kept, wrong lines are told."""
    n = 10_050
    (tmp_path / "a.obj").write_text("".join(f"v {k} 0 0\n" for k in range(n)) + "f " + " ".join(map(str, range(1, n + 1))) + "\n")
    (tmp_path / "b.obj").write_text("# c\nv 0 0 0\nvt 0 1\nv 1 0 0\nvt 0.5 1\nv 1 1 0\nf 1/1 -2/-1 3\nf 1 x 3\nv 1 2\nf 1 2\nvt 7\n")
    m = {k: v.collect() for k, v in files.polygon_mesh(spark, str(tmp_path)).items()}
    own = lambda what, name: [r for r in m[what] if r.mesh.endswith(name)]
    assert {(r.v0, r.v1, r.v2) for r in own("triangles", "a.obj")} == {(1, k, k + 1) for k in range(2, n)}
    assert [(r.line, r.v0, r.v1, r.v2, r.t0, r.t1, r.t2) for r in own("triangles", "b.obj")] == [(7, 1, 2, 3, 1, 2, None)]
    assert sorted((r.tid, r.u, r.v) for r in own("uvs", "b.obj"))[:2] == [(1, 0.0, 1.0), (2, 0.5, 1.0)]
    assert sorted((r.line, r.reason) for r in m["bad"]) == [(8, "face"), (9, "vertex"), (10, "face"), (11, "texture vertex")]


def test_a_level_cut_short_throughout_is_a_mismatch(spark):
    listing = spark.createDataFrame([(0, f"0/{k}", 4) for k in range(9)] + [(0, "0/.meta", 1), (1, "1/0", 8), (2, "2/0", 3), (7, "7/0", 3)], "level int, key string, size long")
    declared = spark.createDataFrame([(0, [2, 2], 2, True), (1, [2, 2], 2, True), (2, [2, 2], 2, False), (3, [2], 1, True), (4, [2], None, True)], "level int, chunks array<long>, itemsize int, plain boolean")
    got = {r.level: (r.status, r.objects, r.bad, r.examples) for r in voxels.size_census(listing, declared, "level", "key", "size").collect()}
    assert got == {0: ("mismatch", 9, 9, "0/0,0/1,0/2,0/3,0/4"), 1: ("ok", 1, 0, None), 2: ("not_applicable", 1, 0, None), 3: ("unverified", 0, 0, None), 4: ("not_applicable", 0, 0, None), 7: ("unverified", 1, 0, None)}


def test_support_distance(spark):
    rng = random.Random(1)
    vox = [(c, z, y, x, 1, rng.random() < (0.03 if c < 3 else 0)) for c in range(4) for z in range(7) for y in range(6) for x in range(9) if rng.random() < 0.7]
    want = Counter()
    for c in range(4):
        firm = [v[1:4] for v in vox if v[0] == c and v[5]]
        for v in vox:
            if v[0] == c and not v[5]:
                d = min((math.dist(v[1:4], f) for f in firm), default=None)
                want[c, -1 if d is None else sum(d > e for e in (1, 1.5, 2, 4))] += 1
    df = spark.createDataFrame([(*v[:5], int(v[5])) for v in vox], "c int, z int, y int, x int, p int, ct int")
    got = {(r.c, r.bin): r.n for r in voxels.support_distance(df, ["c"], "p", "ct", [1.0, 1.5, 2.0, 4.0]).collect()}
    assert got == dict(want)


def test_interpolation_over_many_uneven_controls(spark):
    """More controls than any broadcast was allowed, most of them crowded at one end."""
    from plumbline.plans import inspect

    rng = np.random.default_rng(2)
    at = np.unique(np.r_[rng.uniform(0, 1, 11_000), rng.uniform(1, 1e6, 40)])
    y = rng.uniform(0, 9, len(at))
    points = np.r_[rng.uniform(-5, 1.2e6, 300), rng.uniform(0, 1, 300), at[:5], at[-2:]]
    c = spark.createDataFrame([(float(a), float(b)) for a, b in zip(at, y, strict=True)], "z double, y double")
    p = spark.createDataFrame([(i, float(v), "kept") for i, v in enumerate(points)], "id int, z double, band string")
    df = spatial.interpolated(p, c, "z", ["y"])
    assert not inspect.nested_loops(df)
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(points) and all(r.band == "kept" for r in got.values())
    for i, v in enumerate(points):
        k = min(max(int(np.searchsorted(at, v, "right")) - 1, 0), len(at) - 2)
        t = (v - at[k]) / (at[k + 1] - at[k])
        assert got[i].cy == pytest.approx(y[k] + t * (y[k + 1] - y[k]), rel=1e-6) and got[i].extrapolated == (t < 0 or t > 1)
    assert spatial.interpolated(p, c.limit(0), "z", ["y"]).count() == 0


@pytest.mark.parametrize("kind", ["all on the frontier", "few", "ties"])
def test_pareto_in_bands(spark, kind):
    rng = random.Random(6)
    if kind == "all on the frontier":
        rows = [(k, float(k), 500.0 - k, rng.random()) for k in range(400)]
    else:
        draw = (lambda: rng.uniform(0, 1)) if kind == "few" else (lambda: float(rng.randrange(4)))
        rows = [(k, draw(), draw(), draw()) for k in range(400)]
    rows += [(1000, None, 1e9, 0.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(5)
    got = {r.k for r in spatial.pareto(df, "k", ["a", "b"], ["c"], band=37).collect()}
    beats = lambda x, y: x[1] >= y[1] and x[2] >= y[2] and x[3] <= y[3] and x[1:] != y[1:]
    assert got == {y[0] for y in rows[:-1] if not any(beats(x, y) for x in rows[:-1])}


def test_halo_of_26_neighbours(spark):
    cube = np.arange(6 * 6 * 6).reshape(6, 6, 6)
    rows = [("v", z // 2, y // 2, x // 2, z % 2, y % 2, x % 2, int(cube[z, y, x])) for z in range(6) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(rows, "vol string, cz int, cy int, cx int, z int, y int, x int, v int")
    got = defaultdict(dict)
    for r in voxels.halo(df, ["vol"], 2).collect():
        assert (r.z, r.y, r.x) not in got[r.cz, r.cy, r.cx]
        got[r.cz, r.cy, r.cx][r.z, r.y, r.x] = r.v
    for c in {r[1:4] for r in rows}:
        want = {}
        for at in np.ndindex(4, 4, 4):
            local = tuple(a - 1 for a in at)
            place = tuple(2 * k + a for k, a in zip(c, local, strict=True))
            if all(0 <= p < 6 for p in place) and not all(0 <= a < 2 for a in local):
                want[local] = int(cube[place])
        assert got[c] == want


def test_a_long_chain(spark):
    """Depth is no trouble: levels are written once each, and bridges need none."""
    n = 40
    rows = [(k, k, k + 1, 1, 1.0) for k in range(n)]
    e = spark.createDataFrame(rows, "eid long, i long, j long, d long, w double").coalesce(1)
    tree = {r.node: (r.level, r.pot) for r in graph_op.bfs_forest(e).collect()}
    assert tree == {k: (k, k) for k in range(n + 1)}
    assert trees.bridges(e).count() == n
    assert trees.bridges(e.unionByName(spark.createDataFrame([(n, n, 0, 0, 1.0)], e.schema))).count() == 0


@pytest.mark.parametrize("bright", [True, False])
def test_plates_at_two_scales(spark, bright):
    """Mirrored Gaussian smoothing, second differences, eigenvalues and the response, in numpy."""
    rng = np.random.default_rng(3)
    cubes = rng.uniform(0, 1, (4, 6, 6, 6))
    rows = [(c, *map(int, at), float(cubes[c][at])) for c in range(4) for at in np.ndindex(6, 6, 6)]
    df = spark.createDataFrame(rows, "c int, z int, y int, x int, v double")
    got = {(r.c, r.z, r.y, r.x): (r.response, r.scale) for r in voxels.multiscale_plates(df, ["c"], "v", [0.6, 1.0], 6, 0.5, 0.1, bright).collect()}
    assert len(got) == 4 * 4**3
    mirror = lambda k: -1 - k if k < 0 else 11 - k if k > 5 else k
    unit = np.eye(3, dtype=int)
    for c in range(4):
        best = {}
        for sigma in (0.6, 1.0):
            w, soft = voxels.gaussian(sigma), cubes[c]
            half = len(w) // 2
            for axis in range(3):
                soft = sum(x * np.take(soft, [mirror(k + o - half) for k in range(6)], axis) for o, x in enumerate(w))
            for at in np.ndindex(4, 4, 4):
                p, h = np.array(at) + 1, np.zeros((3, 3))
                for a in range(3):
                    h[a, a] = soft[tuple(p + unit[a])] + soft[tuple(p - unit[a])] - 2 * soft[tuple(p)]
                    for b in range(a):
                        h[a, b] = h[b, a] = sum(s * t * soft[tuple(p + s * unit[a] + t * unit[b])] for s in (1, -1) for t in (1, -1)) / 4
                e = sorted(np.linalg.eigvalsh(h * sigma**2), key=abs)
                ok = e[2] < 0 if bright else e[2] > 0
                r = math.exp(-0.5 * (abs(e[1] / e[2]) / 0.5) ** 2) * (1 - math.exp(-0.5 * (sum(x * x for x in e) / 0.01))) if ok else 0.0
                k = (c, *map(int, p))
                if k not in best or r > best[k][0] + 1e-12:
                    best[k] = r, sigma
        for k, (r, sigma) in best.items():
            assert got[k][0] == pytest.approx(r, abs=1e-6) and (r < 1e-9 or got[k][1] == sigma)


@pytest.mark.parametrize(("sets", "want"), [([{1, 2}, {1, 2}], "identical_full_set"), ([{1, 2}, {3}], "disjoint_subsets"), ([{1, 2}, {2, 3}, {1, 3}], "cv_partition"), ([{1, 2, 3}, {2, 3}, {1, 3}], "partial_overlap"), ([{1, 2}, {2, 3}, {2}], "partial_overlap"), ([{1}], None)])
def test_overlap_regime(spark, sets, want):
    from plumbline.operators import rules

    df = spark.createDataFrame([(7, m, u) for m, s in enumerate(sets) for u in s] + [(8, 0, 1), (8, 1, 2)], "g int, m int, u int")
    assert {r.g: r.regime for r in rules.overlap_regime(df, ["g"], "m", "u").collect()} == {7: want, 8: "disjoint_subsets"}


def test_a_review_that_moved_is_refused_whole(spark):
    from plumbline.operators import rules

    s = spark.createDataFrame([(1, 5.0, 1.0), (2, 6.0, None), (3, 7.0, 3.0)], "id int, v double, x double")
    run = lambda led: {r.id: (r.v, r.changed, r.refused) for r in rules.reviewed(s, spark.createDataFrame(led, "id int, before double, after double, x double"), "id", "v", ["x"]).collect()}
    assert run([(1, 5.0, 9.0, 1.0), (2, 6.0, 6.0, None)]) == {1: (9.0, True, False), 2: (6.0, False, False), 3: (7.0, False, False)}
    for wrong in ([(1, 5.0, 9.0, 1.5)], [(1, 5.0, 9.0, 1.0), (4, 0.0, 0.0, 0.0)], [(1, 5.5, 9.0, 1.0)], [(1, 5.0, 9.0, 1.0), (1, 5.0, 8.0, 1.0)]):
        assert run(wrong) == {1: (5.0, False, True), 2: (6.0, False, True), 3: (7.0, False, True)}
