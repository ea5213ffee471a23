"""Box reads of landed arrays and components of chunked volumes, against whole arrays in numpy."""

import json
import os
from collections import Counter, deque
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import volumes
from plumbline.sources import arrays


@pytest.fixture
def landed(spark, tmp_path):
    """Two levels of (10, 9, 7) and (5, 5, 4) voxels in chunks of (4, 3, 2), a third of the chunks absent."""
    rng, whole, rows = np.random.default_rng(3), [], []
    for level, shape in enumerate([(10, 9, 7), (5, 5, 4)]):
        full = np.zeros([-(-s // c) * c for s, c in zip(shape, (4, 3, 2), strict=True)], np.uint8)
        for c in product(*(range(-(-s // k)) for s, k in zip(shape, (4, 3, 2), strict=True))):
            if sum(c) % 3 != 1:
                at = tuple(slice(i * k, i * k + k) for i, k in zip(c, (4, 3, 2), strict=True))
                full[at] = rng.integers(1, 255, (4, 3, 2))
                rows.append((level, *c, bytearray(full[at].tobytes())))
        whole.append(full[tuple(map(slice, shape))])
    levels = [{"name": f"s{k}", "scale": [2.0**k] * 3, "shape": list(w.shape), "chunks": [4, 3, 2], "dimension_separator": "/" if k else "."} for k, w in enumerate(whole)]
    path = str(tmp_path / "array")
    arrays.write_array(levels, path, spark.createDataFrame(rows, "level int, cz int, cy int, cx int, content binary"))
    return path, whole


@pytest.mark.parametrize(("level", "lo", "hi"), [(0, (0, 0, 0), (10, 9, 7)), (0, (3, 2, 1), (5, 8, 6)), (1, (-4, 1, 1), (99, 4, 3)), (1, (4, 4, 3), (5, 5, 4)), (0, (5, 5, 5), (5, 9, 7)), (0, (50, 0, 0), (60, 9, 7))])
def test_boxes(spark, landed, level, lo, hi):
    path, whole = landed
    box = arrays.box_chunks(spark, path, level, lo, hi)
    got = {(r.z, r.y, r.x): r.v for r in arrays.box_voxels(box, (4, 3, 2), lo, tuple(min(h, s) for h, s in zip(hi, whole[level].shape, strict=True))).collect()}
    want = whole[level]
    cells = set(product(*(range(max(0, a), min(b, s)) for a, b, s in zip(lo, hi, want.shape, strict=True))))
    assert set(got) <= cells and all(got.get(c, 0) == want[c] for c in cells)
    touched = set(product(*(range(max(0, a) // k, -(-min(b, s) // k)) for a, b, s, k in zip(lo, hi, want.shape, (4, 3, 2), strict=True)))) if cells else set()
    assert {(r.cz, r.cy, r.cx) for r in box.collect()} == touched


def test_only_what_the_box_and_filters_leave_is_opened(spark, landed):
    """Every other chunk becomes a folder, which nobody can open as a file."""
    path, _ = landed
    keep = {"1.0.0", "1.1.0", "1.1.1", "1.0.1"}
    for name in os.listdir(f"{path}/s0"):
        if name != ".zarray" and not name.endswith(".crc") and name not in keep:
            os.remove(f"{path}/s0/{name}")
            os.mkdir(f"{path}/s0/{name}")
    box = arrays.box_chunks(spark, path, 0, (4, 0, 0), (8, 6, 4))
    assert box.count() == 4
    narrowed = arrays.box_chunks(spark, path).where("level = 0 AND cz = 1 AND cy < 2 AND cx <= 1")
    assert {(r.cz, r.cy, r.cx) for r in narrowed.collect()} == {(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)}
    with pytest.raises(Exception, match="(?i)director|regular file"):
        arrays.box_chunks(spark, path, 0).count()


def test_wrong_lengths_and_refusals(spark, landed, tmp_path):
    path, _ = landed
    with open(f"{path}/s0/0.0.0", "wb") as f:
        f.write(b"short")
    assert arrays.box_chunks(spark, path, 0, (0, 0, 0), (1, 1, 1)).first().status == "decode_failure"
    good = {"zarr_format": 2, "dtype": "|u1", "order": "C", "shape": [4, 4, 4], "chunks": [2, 2, 2], "fill_value": 0, "compressor": None}
    axes = {"multiscales": [{"axes": [{"name": a} for a in "zyx"], "datasets": [{"path": "0"}, {"path": "1"}]}]}
    cases = {"fine": (axes, good, good), "axes": ({"multiscales": [{"axes": [{"name": "x"}], "datasets": []}]}, good, good), "none": ({}, good, good), "format": (axes, good, good | {"zarr_format": 3}), "dtype": (axes, good | {"dtype": "<u2"}, good), "order": (axes, good | {"order": "F"}, good), "packed": (axes, good | {"filters": [1]}, good), "flat": (axes, good | {"shape": [4, 4]}, good), "fill": (axes, good, good | {"fill_value": 7}), "absent": (axes, good, None)}
    for name, (attrs, *levels) in cases.items():
        for k, d in enumerate(levels):
            os.makedirs(tmp_path / name / str(k))
            if d is not None:
                (tmp_path / name / str(k) / ".zarray").write_text(json.dumps(d))
        (tmp_path / name / ".zattrs").write_text(json.dumps(attrs))
    table = spark.createDataFrame([(str(tmp_path / n),) for n in [*cases, "nowhere"]], "p string")
    got = arrays.array_levels(table, "p").collect()
    status = Counter((r.path.rpartition("/")[2], r.status) for r in got)
    assert status == Counter({("fine", "usable"): 2, **{(n, "refused"): 1 for n in [*cases, "nowhere"] if n != "fine"}})
    assert {tuple(r.scale) for r in got if r.status == "usable"} == {(1.0, 1.0, 1.0), (2.0, 2.0, 2.0)} and all(r.reason for r in got if r.status == "refused")


def flood(mask, steps):
    """(first voxel) of every voxel of the mask."""
    both = [d for s in steps for d in (s, tuple(-k for k in s))]
    out = {}
    for first in map(tuple, np.argwhere(mask)):
        if first in out:
            continue
        out[first], todo = first, deque([first])
        while todo:
            v = todo.popleft()
            for d in both:
                n = tuple(a + b for a, b in zip(v, d, strict=True))
                if all(0 <= a < s for a, s in zip(n, mask.shape, strict=True)) and mask[n] and n not in out:
                    out[n] = first
                    todo.append(n)
    return out


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_volume_components(spark, connectivity):
    shape, size = (11, 9, 10), (4, 3, 5)
    rng = np.random.default_rng(connectivity)
    volumes_ = {v: (rng.random(shape) < p) * np.uint8(200) for v, p in (("thin", 0.1), ("thick", 0.4), ("none", 0.0), ("full", 1.0))}
    snake = np.zeros(shape, np.uint8)
    for y in range(0, 9, 2):
        snake[5, y, :] = 200
        if y + 1 < 9:
            snake[5, y + 1, 0 if y % 4 else 9] = 200
    volumes_["snake"] = snake
    rows = []
    for v, a in volumes_.items():
        full = np.full([-(-s // k) * k for s, k in zip(shape, size, strict=True)], 255, np.uint8)  # what is beyond the shape is not read
        full[tuple(map(slice, shape))] = a
        for c in product(*(range(n // k) for n, k in zip(full.shape, size, strict=True))):
            rows.append((v, *c, bytearray(full[tuple(slice(i * k, i * k + k) for i, k in zip(c, size, strict=True))].tobytes())))
    df = spark.createDataFrame(rows, "volume string, cz int, cy int, cx int, content binary").repartition(6)
    found = volumes.volume_components(df, "volume", size, shape, 100, connectivity)
    want, edge = {}, {}
    for v, a in volumes_.items():
        for at, first in flood(a >= 100, volumes.directions(connectivity)).items():
            want[v, *map(int, at)] = (int(first[0]) * 9 + int(first[1])) * 10 + int(first[2])
            name = (v, want[v, *map(int, at)])
            edge[name] = edge.get(name, False) or any(i in (0, s - 1) for i, s in zip(at, shape, strict=True))
    assert {(r.volume, r.z, r.y, r.x): r.component for r in found["voxels"].collect()} == want
    sizes, total = Counter((k[0], c) for k, c in want.items()), Counter(k[0] for k in want)
    got = {(r.volume, r.component): (r.size, r.border) for r in found["components"].collect()}
    assert got == {k: (n, edge[k]) for k, n in sizes.items()}
    assert all(r.share == pytest.approx(r.size / total[r.volume]) for r in found["components"].collect())
    assert found["components"].where(F.col("volume") == "snake").count() == 1


def test_label_chunk_follows_long_ways():
    mask = np.zeros((1, 41, 41), bool)
    mask[0, ::2] = True
    for y in range(1, 41, 2):
        mask[0, y, 40 if y % 4 == 1 else 0] = True
    label = volumes.label_chunk(mask, volumes.directions(6))
    assert set(label[mask].tolist()) == {0} and (label[~mask] == -1).all()
