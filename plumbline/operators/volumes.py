"""Components of chunked volumes: chunks are labelled whole where they are, and only what touches their faces meets others."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graphs import components, settled


def directions(connectivity: int) -> list[tuple[int, int, int]]:
    """Of the 6, 18 or 26 neighbours of a voxel, those that come later in z-y-x order."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0) and sum(map(abs, d)) <= most]


def label_chunk(mask: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """For each voxel of a mask the smallest place (in z-y-x order) that it reaches inside the chunk; -1 outside the mask. Smaller labels spread over all contacts at once, then every label is followed to its own."""
    label = np.where(mask.ravel(), np.arange(mask.size), -1)
    place = np.arange(mask.size).reshape(mask.shape)
    pairs = []
    for d in steps:
        here = tuple(slice(max(0, -k), min(s, s - k)) for k, s in zip(d, mask.shape, strict=True))
        there = tuple(slice(max(0, k), min(s, s + k)) for k, s in zip(d, mask.shape, strict=True))
        both = mask[here] & mask[there]
        pairs.append(np.stack([place[here][both], place[there][both]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label.reshape(mask.shape)
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        inside = label >= 0
        while True:
            jumped = np.where(inside, label[label], -1)
            if (jumped == label).all():
                break
            label = jumped


def volume_components(chunks: DataFrame, volume: str, size: tuple[int, int, int], shape: tuple[int, int, int], least: int, connectivity: int = 26) -> dict[str, DataFrame]:
    """Components of the voxels with a value of ``least`` or more, over all chunks of each volume.

    chunks: volume, cz, cy, cx, content (bytes, z-y-x; the part beyond ``shape`` is ignored). Returns
    ``components`` (volume, component, size, share, border): a component is named by its first voxel,
    (z * ny + y) * nx + x; share is that of the volume's mask, border whether it touches the volume's
    outside, else it is enclosed; and ``voxels`` (volume, z, y, x, component). A chunk is labelled in its
    task; only voxels on chunk faces with something of the mask across are shuffled to be joined.
    """
    nz, ny, nx = shape
    steps = directions(connectivity)
    kind = dict(chunks.dtypes)[volume]
    rows = chunks.select(F.col(volume).alias("volume"), "cz", "cy", "cx", "content").where("content IS NOT NULL")

    def told(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k in range(b.num_rows):
                first = [b.column(c)[k].as_py() * s for c, s in zip((1, 2, 3), size, strict=True)]
                raw = np.frombuffer(b.column(4)[k].as_buffer(), np.uint8).reshape(size)
                keep = tuple(slice(0, max(0, min(s, n - f))) for s, n, f in zip(size, shape, first, strict=True))
                mask = raw[keep] >= least
                if not mask.any():
                    continue
                label = label_chunk(mask, steps)
                z, y, x = np.nonzero(mask)
                lz, ly, lx = np.unravel_index(label[z, y, x], mask.shape)
                name = ((lz + first[0]).astype(np.int64) * ny + ly + first[1]) * nx + lx + first[2]
                face = np.zeros(len(z), bool)
                for at, s in zip((z, y, x), mask.shape, strict=True):
                    face |= (at == 0) | (at == s - 1)
                yield b.slice(k, 1).column(0), z + first[0], y + first[1], x + first[2], name, face

    def same(volume_of: pa.Array, n: int) -> pa.Array:
        return volume_of.take(pa.array(np.zeros(n, np.int64)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, z, y, x, name, _ in told(batches):
            border = np.zeros(len(z), bool)
            for at, s in ((z, nz), (y, ny), (x, nx)):
                border |= (at == 0) | (at == s - 1)
            local, back, n = np.unique(name, return_inverse=True, return_counts=True)
            touch = np.bincount(back, weights=border) > 0
            yield pa.RecordBatch.from_arrays([same(v, len(local)), pa.array(local), pa.array(n.astype(np.int64)), pa.array(touch)], ["volume", "local", "n", "border"])

    def voxels(batches: Iterator[pa.RecordBatch], faces: bool) -> Iterator[pa.RecordBatch]:
        for v, z, y, x, name, face in told(batches):
            at = np.flatnonzero(face) if faces else np.arange(len(z))
            yield pa.RecordBatch.from_arrays([same(v, len(at)), *[pa.array(c[at].astype(np.int32)) for c in (z, y, x)], pa.array(name[at])], ["volume", "z", "y", "x", "local"])

    schema = f"volume {kind}, z int, y int, x int, local long"
    pieces = settled(rows.mapInArrow(parts, f"volume {kind}, local long, n long, border boolean"))
    faces = settled(rows.mapInArrow(lambda b: voxels(b, True), schema))
    chunk = [F.floor(F.col(a) / s) for a, s in zip("zyx", size, strict=True)]
    step = F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for k, a in zip(d, ("dz", "dy", "dx"), strict=True)]) for d in steps])).alias("d")
    to = faces.select("volume", *[c.alias(f"c{a}") for c, a in zip(chunk, "zyx", strict=True)], "z", "y", "x", F.col("local").alias("a"), step)
    to = to.select("volume", "cz", "cy", "cx", *[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "zyx"], "a")
    # a step that stays in its chunk has been taken there
    to = to.where(" OR ".join(f"floor({a} / {s}) <> c{a}" for a, s in zip("zyx", size, strict=True)))
    met = to.join(faces.withColumnRenamed("local", "b"), ["volume", "z", "y", "x"]).select(F.struct("volume", F.col("a").alias("local")).alias("a"), F.struct("volume", F.col("b").alias("local")).alias("b")).distinct()
    found = components(met, "a", "b").select(F.col("node.volume").alias("volume"), F.col("node.local").alias("local"), F.col("component.local").alias("component"))
    named = settled(pieces.select("volume", "local").join(found, ["volume", "local"], "left").select("volume", "local", F.coalesce("component", "local").alias("component")))
    sized = pieces.join(named, ["volume", "local"]).groupBy("volume", "component").agg(F.sum("n").alias("size"), F.bool_or("border").alias("border"))
    whole = sized.groupBy("volume").agg(F.sum("size").alias("whole"))
    sized = sized.join(whole, "volume").select(F.col("volume").alias(volume), "component", "size", (F.col("size") / F.col("whole")).alias("share"), "border")
    every = rows.mapInArrow(lambda b: voxels(b, False), schema).join(named, ["volume", "local"]).select(F.col("volume").alias(volume), "z", "y", "x", "component")
    return {"components": sized, "voxels": every}
