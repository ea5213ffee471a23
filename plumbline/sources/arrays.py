"""Chunked arrays of bytes as they are landed: multiscale metadata, and boxes that read only the chunks they touch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Chunks that a task reads.
PER_TASK = 64
CHUNKS = "level int, cz int, cy int, cx int, status string, content binary"
LEVELS = "level int, name string, shape array<int>, chunks array<int>, scale array<double>, separator string, fill_value int"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    store, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return store, at.rstrip("/")


def stored(store: fs.FileSystem, path: str) -> bytes | None:
    """What a file holds; None if there is none."""
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


@dataclass
class Level:
    level: int
    name: str
    shape: list[int]
    chunks: list[int]
    scale: list[float]
    separator: str
    fill_value: int

    @property
    def grid(self) -> list[int]:
        return [-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True)]


def levels_of(path: str) -> list[Level]:
    """The levels of one array, from .zattrs and each level's .zarray. Whatever is not three axes z, y, x of plain bytes in C order, with one fill value, is refused with a ValueError that says why."""
    store, at = opened(path)

    def read(name: str) -> dict:
        raw = stored(store, f"{at}/{name}")
        if raw is None:
            raise ValueError(f"no {name}")
        try:
            got = json.loads(raw)
        except ValueError as e:
            raise ValueError(f"{name} is no JSON") from e
        if not isinstance(got, dict):
            raise ValueError(f"{name} is no object")
        return got

    try:
        scales = read(".zattrs")["multiscales"][0]
        axes, sets = [a["name"] for a in scales["axes"]], scales["datasets"]
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError("no usable multiscales") from e
    if axes != ["z", "y", "x"]:
        raise ValueError(f"axes {axes} are not z, y, x")
    out = []
    for k, one in enumerate(sets):
        name, scale = one["path"], [float(2**k)] * 3
        for t in one.get("coordinateTransformations", []):
            if t.get("type") == "scale":
                scale = [float(x) for x in t["scale"]]
        d = read(f"{name}/.zarray")
        if d.get("zarr_format") != 2:
            raise ValueError("format is not 2")
        if d.get("dtype") not in ("|u1", "<u1", "u1"):
            raise ValueError(f"type {d.get('dtype')} is not a byte")
        if d.get("compressor") is not None or d.get("filters"):
            raise ValueError("chunks are compressed or filtered")
        if d.get("order", "C") != "C":
            raise ValueError("order is not C")
        if len(d.get("shape", [])) != 3 or len(d.get("chunks", [])) != 3 or min(d["chunks"]) < 1:
            raise ValueError("not three axes")
        out.append(Level(k, name, [int(x) for x in d["shape"]], [int(x) for x in d["chunks"]], scale, d.get("dimension_separator", "."), int(d.get("fill_value") or 0)))
    if not out:
        raise ValueError("no levels")
    if len({x.fill_value for x in out}) > 1:
        raise ValueError("levels disagree on the fill value")
    return out


def array_levels(arrays: DataFrame, path_col: str) -> DataFrame:
    """(path, level, name, shape, chunks, scale, separator, fill_value, status, reason): a row for each level of each array of the table; an array that is refused is one row that says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("level", pa.int32()), ("name", pa.string()), ("shape", pa.list_(pa.int32())), ("chunks", pa.list_(pa.int32())), ("scale", pa.list_(pa.float64())), ("separator", pa.string()), ("fill_value", pa.int32()), ("status", pa.string()), ("reason", pa.string())])
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    rows += [{"path": path, **vars(x), "status": "usable", "reason": None} for x in levels_of(path)]
                except ValueError as e:
                    rows.append({"path": path, "status": "refused", "reason": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return arrays.select(F.col(path_col).cast("string").alias("path")).mapInArrow(run, f"path string, {LEVELS}, status string, reason string")


@dataclass
class Run(InputPartition):
    """Chunks ``start`` to ``stop`` of a box of chunk indices, in z-y-x order."""

    level: Level
    low: tuple[int, ...]
    high: tuple[int, ...]
    start: int
    stop: int


class BoxReader(DataSourceReader):
    """Plans a task for each PER_TASK chunks of the box; comparisons of level, cz, cy and cx with numbers narrow it, so that what a filter leaves out is never opened."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.lo = [int(x) for x in options["lo"].split(",")] if "lo" in options else None
        self.hi = [int(x) for x in options["hi"].split(",")] if "hi" in options else None
        self.bounds = {c: [0, 1 << 40] for c in ("level", "cz", "cy", "cx")}
        if "level" in options:
            self.bounds["level"] = [int(options["level"]), int(options["level"]) + 1]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = (f.attribute[0], f.value) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else (None, None)
            if name not in self.bounds or not isinstance(value, int):
                yield f
                continue
            b = self.bounds[name]
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                b[0] = max(b[0], value)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                b[1] = min(b[1], value + 1)
            if isinstance(f, GreaterThan):
                b[0] = max(b[0], value + 1)
            if isinstance(f, LessThan):
                b[1] = min(b[1], value)

    def partitions(self) -> list[Run]:
        out = []
        for x in levels_of(self.path):
            if not self.bounds["level"][0] <= x.level < self.bounds["level"][1]:
                continue
            lo = [max(0, v) for v in self.lo or (0, 0, 0)]
            hi = [min(s, v) for s, v in zip(x.shape, self.hi or x.shape, strict=True)]
            low = [max(v // c, self.bounds[a][0]) for v, c, a in zip(lo, x.chunks, ("cz", "cy", "cx"), strict=True)]
            high = [min(-(-v // c), self.bounds[a][1]) for v, c, a in zip(hi, x.chunks, ("cz", "cy", "cx"), strict=True)]
            n = int(np.prod([max(0, b - a) for a, b in zip(low, high, strict=True)])) if all(h > v for v, h in zip(lo, hi, strict=True)) else 0
            out += [Run(x, tuple(low), tuple(high), k, min(k + PER_TASK, n)) for k in range(0, n, PER_TASK)]
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a box that touches nothing
            return
        store, at = opened(self.path)
        x, size = partition.level, int(np.prod(partition.level.chunks))
        wide = [b - a for a, b in zip(partition.low, partition.high, strict=True)]
        for k in range(partition.start, partition.stop):
            c = [a + int(i) for a, i in zip(partition.low, np.unravel_index(k, wide), strict=True)]
            raw = stored(store, f"{at}/{x.name}/" + x.separator.join(map(str, c)))
            status = "fill" if raw is None else "decoded" if len(raw) == size else "decode_failure"
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (x.level, *c)], pa.array([status]), pa.array([raw if status == "decoded" else None], pa.binary())], ["level", "cz", "cy", "cx", "status", "content"])


class ChunkedArray(DataSource):
    """``spark.read.format("chunkedarray")``: options path, and, if not all is wanted, level, lo and hi (z,y,x of the level, lo inside, hi outside)."""

    @classmethod
    def name(cls) -> str:
        return "chunkedarray"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> BoxReader:
        return BoxReader(dict(self.options))


def box_chunks(spark: SparkSession, path: str, level: int | None = None, lo: tuple[int, int, int] | None = None, hi: tuple[int, int, int] | None = None) -> DataFrame:
    """(level, cz, cy, cx, status, content): the chunks that the half-open box [lo, hi) touches, clipped to the array. An absent chunk is a row with status fill and no content, a chunk of a wrong length a decode_failure. Later filters on level, cz, cy and cx narrow what is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedArray)
    reader = spark.read.format("chunkedarray").option("path", path)
    for name, value in (("level", level), ("lo", lo and ",".join(map(str, lo))), ("hi", hi and ",".join(map(str, hi)))):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()


def box_voxels(chunks: DataFrame, size: tuple[int, int, int], lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """(level, z, y, x, v): the voxels of decoded chunks inside the box [lo, hi); what is absent is the fill value and no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = [r[a] * s for a, s in zip(("cz", "cy", "cx"), size, strict=True)]
                cut = [(max(v - f, 0), min(h - f, s)) for v, h, f, s in zip(lo, hi, first, size, strict=True)]
                if any(a >= e for a, e in cut):
                    continue
                v = np.frombuffer(r["content"], np.uint8).reshape(size)[tuple(slice(*c) for c in cut)]
                at = np.indices(v.shape).reshape(3, -1) + np.array([[f + c[0]] for f, c in zip(first, cut, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, r["level"], np.int32)), *[pa.array(a.astype(np.int32)) for a in at], pa.array(v.ravel().astype(np.int32))], ["level", "z", "y", "x", "v"])

    return chunks.where("status = 'decoded'").select("level", "cz", "cy", "cx", "content").mapInArrow(run, "level int, z int, y int, x int, v int")


def write_metadata(levels: list[dict], path: str) -> None:
    """.zattrs and each level's .zarray. levels: name, scale; all else goes into .zarray as it is."""
    store, at = opened(path)

    def put(name: str, what: dict) -> None:
        store.create_dir(name.rpartition("/")[0])
        with store.open_output_stream(name) as f:
            f.write(json.dumps(what).encode())

    sets = [{"path": x["name"], "coordinateTransformations": [{"type": "scale", "scale": x["scale"]}]} for x in levels]
    put(f"{at}/.zattrs", {"multiscales": [{"axes": [{"name": a} for a in "zyx"], "datasets": sets}]})
    for x in levels:
        plain = {"zarr_format": 2, "dtype": "|u1", "order": "C", "fill_value": 0, "compressor": None, "filters": None}
        put(f"{at}/{x['name']}/.zarray", plain | {k: v for k, v in x.items() if k not in ("name", "scale")})


def write_array(levels: list[dict], path: str, chunks: DataFrame) -> None:
    """A multiscale array: its metadata, and a file for each row of ``chunks`` (level, cz, cy, cx, content), written by the tasks. A repeated task writes the same files again."""
    write_metadata(levels, path)
    names, separators = [x["name"] for x in levels], [x.get("dimension_separator", ".") for x in levels]

    def run(rows) -> None:
        store, at = opened(path)
        for r in rows:
            name = f"{at}/{names[r.level]}/" + separators[r.level].join(map(str, (r.cz, r.cy, r.cx)))
            store.create_dir(name.rpartition("/")[0])
            with store.open_output_stream(name) as f:
                f.write(bytes(r.content))

    chunks.select("level", "cz", "cy", "cx", "content").foreachPartition(run)
