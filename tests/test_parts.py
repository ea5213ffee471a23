"""File scans, streams, probes and plans on small inputs."""

import json

import numpy as np
import pytest
from plumbline import catalog
from plumbline.catalog.fixtures import points, voxels
from plumbline.operators import evaluation, spatial
from plumbline.operators import voxels as vox
from plumbline.plans import inspect
from plumbline.sources import files

DATA = "/root/testdata/sf0.001"


def test_chunk_objects(spark, tmp_path):
    rng = np.random.default_rng(0)
    cube = rng.integers(0, 256, (4, 4, 4), dtype=np.uint8)
    for cz in (0, 1):
        (tmp_path / f"0/{cz}/0").mkdir(parents=True)
        (tmp_path / f"0/{cz}/0/0").write_bytes(cube[2 * cz : 2 * cz + 2].tobytes())
    (tmp_path / "0/0/0/1").write_bytes(b"short")
    c = files.chunk_objects(spark, str(tmp_path), 32)
    assert sorted(r.status for r in c.collect()) == ["decode_failure", "decoded", "decoded"]
    got = files.chunk_voxels(c, (2, 4, 4)).collect()
    assert len(got) == 64 and all(cube[r.z, r.y, r.x] == r.v for r in got)


def test_documents_as_tables(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"shape": [4, 4, 4], "chunks": [2, 2, 2], "dtype": "|u1", "order": "C", "fill_value": 0, "compressor": None}))
    (tmp_path / "other.json").write_text(json.dumps({"shape": [4], "chunks": [2], "dtype": "<f4", "order": "C"}))
    assert sorted(r.status for r in files.array_metadata(spark, str(tmp_path)).collect()) == ["refused", "usable"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/index.json").write_text(json.dumps({"samples": {"s1": {"volumes": {"v1": {"data": [{"origin": "a"}, {"origin": "b"}]}}}, "s2": {"volumes": {"v2": {"data": [{"origin": "c"}]}}}}}))
    assert {tuple(r) for r in files.catalogue(spark, str(tmp_path / "c"), ["s1"]).collect()} == {("s1", "v1", "a"), ("s1", "v1", "b")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.json").write_text(json.dumps({"id": "t1", "line_points": [[0, 0, 0], [1, 0, 0]], "control_points": [[1, 0, 0]], "segments": [{"mode": "auto"}]}))
    got = files.trace_json(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in got["points"].orderBy("ord").collect()] == [("t1", 0, 0, 0, 0), ("t1", 1, 1, 0, 0)] and got["segments"].first().mode == "auto"
    (tmp_path / "p.json").write_text(json.dumps({"collections": {"7": {"absolute": True, "points": {"1": {"p": [1, 2, 3], "wind_a": 4.0}, "2": {"p": [1, 2, 3], "wind_a": 4.5}}}}}))
    assert [tuple(r) for r in files.point_collections(spark, str(tmp_path / "p.json"), "r").collect()] == [("r", "absolute", "7", "1", 1, 2, 3, 4)]


def test_bad_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trace_id,ord,x,y,z\na,1,0,0,0\na,two,0,0,0\na,3,0,,0\n")
    good, bad = files.trace_csv(spark, str(tmp_path / "t.csv"))
    assert good.count() == 1 and bad.count() == 2
    (tmp_path / "e.csv").write_text("a,b\n1.0,2\nx,3\n")
    good, bad = files.edge_csv(spark, str(tmp_path / "e.csv"))
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and bad.count() == 1


def test_polygon_mesh(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\nv 2 2 2\nf -1/1 -2/1 1/1\n")
    m = files.polygon_mesh(spark, str(tmp_path / "m.obj"))
    assert [r.vid for r in m["vertices"].orderBy("vid").collect()] == [1, 2, 3, 4, 5]
    assert sorted((r.v0, r.v1, r.v2) for r in m["triangles"].collect()) == [(1, 2, 3), (1, 3, 4), (5, 4, 1)]


def test_digests_and_sinks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text("same")
    (tmp_path / "b" / "y").write_text("more")
    got = {r.package: (r.files, r.sha) for r in files.tree_digest(spark, str(tmp_path)).collect()}
    assert got["a"][0] == 1 and got["b"][0] == 2 and got["a"][1] != got["b"][1]
    assert files.listing(spark, str(tmp_path)).count() == 3
    df = spark.range(3)
    files.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(df, str(tmp_path / "out"))


def test_capped_ledger_is_the_loop(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    total, want = {}, {}
    for r in rows:
        ok = total.get(r.user_id, 0.0) + r.value <= 1500
        total[r.user_id] = total.get(r.user_id, 0.0) + (r.value if ok else 0)
        want[r.event_id] = ok
    assert {r.event_id: r.accepted for r in catalog.queries()["k02_capped_ledger"](spark, DATA).collect()} == want


def test_plate_response_is_the_largest_eigenvalue(spark):
    v = np.zeros((2, 4, 4, 4))
    rows = voxels(spark, DATA).where("chunk < 2").collect()
    for r in rows:
        v[r.chunk, r.z, r.y, r.x] = r.v
    got = vox.plate_response(voxels(spark, DATA).where("chunk < 2"), ["volume", "chunk"]).collect()
    assert len(got) == 16
    for r in got:
        h, p, c = np.zeros((3, 3)), np.array([r.z, r.y, r.x]), v[r.chunk]
        unit = np.eye(3, dtype=int)
        for a in range(3):
            h[a, a] = c[tuple(p + unit[a])] + c[tuple(p - unit[a])] - 2 * c[tuple(p)]
            for b in range(a):
                h[a, b] = h[b, a] = sum(s * t * c[tuple(p + s * unit[a] + t * unit[b])] for s in (1, -1) for t in (1, -1)) / 4
        assert r.strength == pytest.approx(np.abs(np.linalg.eigvalsh(h)).max(), abs=1e-5)


def test_ridge_probe_is_the_solve(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, y, i = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]), np.array([r.vec_id for r in rows])
    t = i % 2 == 0
    z = (x - x[t].mean(0)) / x[t].std(0)
    one = (y[:, None] == np.unique(y)[None]).astype(float)
    w = np.linalg.solve(z[t].T @ z[t] + 10 * np.eye(64), z[t].T @ (one[t] - one[t].mean(0)))
    guess = np.unique(y)[(z[~t] @ w + one[t].mean(0)).argmax(1)]
    want = {k: (guess[y[~t] == k] == k).mean() for k in np.unique(y[~t])}
    got = {r.label: r.recall for r in evaluation.ridge_probe(df, "embedding", 64, "label", "vec_id % 2 = 0", 10.0).collect()}
    assert got == pytest.approx(want)


def test_spatial_plans_have_no_nested_loops(spark):
    p = points(spark, DATA)
    plans = [spatial.ray_order(p, 3.0, 2, 40.0, 5.0), spatial.within_radius(p, "frame", "id", ["x", "y", "z"], 4.0), spatial.nearest(p, p.withColumnRenamed("id", "o"), ["frame"], ["x", "y"], "id", "o", 5.0, 5.0)]
    assert not any(inspect.nested_loops(d) for d in plans)


def test_scans_are_pruned(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_quantity > 10").select("l_suppkey")
    assert any("l_quantity" in f for f in inspect.pushed_filters(df)) and set(inspect.read_columns(df)) == {"l_suppkey", "l_quantity"}


def test_point_to_mesh_is_the_nearest_triangle(spark):
    from plumbline.operators import surfaces

    rng = np.random.default_rng(5)
    pts = rng.uniform(0, 20, (30, 3))
    tri = rng.uniform(0, 20, (40, 3, 3))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "id long, x double, y double, z double")
    t = spark.createDataFrame([(i, *map(float, x.ravel())) for i, x in enumerate(tri)], "fid long, " + ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz"))
    u = np.linspace(0, 1, 60)
    mesh = np.array([(a, b) for a in u for b in u if a + b <= 1])
    got = {r.id: r for r in surfaces.point_to_mesh(p, t, "id", 20.0).collect()}
    for i, x in enumerate(pts):
        dense = np.array([np.linalg.norm(a + mesh[:, :1] * (b - a) + mesh[:, 1:] * (c - a) - x, axis=1).min() for a, b, c in tri])
        assert got[i].d <= dense.min() + 1e-9 and got[i].d == pytest.approx(dense[got[i].fid], abs=0.35)
