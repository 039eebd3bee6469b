"""Shapefiles as a Spark data source: format `shapefile`, read by ranges of records, from folders and from zips.

The index (.shx) says where each record begins, so a large file is read by many tasks, each its own range of the shapes and of the attribute rows.
Without an index, one task reads the file from its beginning. Points, multipoints, lines and polygons are read, with or without z and m values
(which are left out); null shapes stay as rows without parts, deleted attribute rows leave out their record.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voltspan.sources.files import listed, opened

#: Shape codes; codes 10 and 20 higher have z and m values too.
KINDS = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
SCHEMA = "file string, number int, kind string, parts array<array<struct<lon:double,lat:double>>>, attributes map<string,string>"
#: Records that a task reads (more where a file would need more than TASKS), unless the option `records` says otherwise, and those that it decodes at once.
RECORDS, AT_ONCE = 100_000, 10_000
#: Tasks that a file is read by at most. Its index counts places in a file in 31 bits of 16-bit words, so a task has 16 MB of shapes at most.
TASKS = 256


@dataclass
class Records(InputPartition):
    """Records first to last of the shapefile `stem`, in a zip or beside each other. last None: to the end, without an index."""

    path: str
    member: str | None
    endings: dict[str, str]
    first: int
    last: int | None

    def open(self, ending: str, system, holder: list) -> BinaryIO | None:
        name = self.endings.get(ending)
        if name is None:
            return None
        if self.member is None:
            return system.open_input_file(name)
        if not holder:
            holder.append(zipfile.ZipFile(system.open_input_file(self.path)))
        return holder[0].open(name)


def stems(names: list[str]) -> dict[str, dict[str, str]]:
    """The files of each shapefile by their endings."""
    found: dict[str, dict[str, str]] = {}
    for n in names:
        stem, _, ending = n.rpartition(".")
        found.setdefault(stem, {})[ending.lower()] = n
    return {k: v for k, v in sorted(found.items()) if "shp" in v}


def fields(head: bytes, encoding: str) -> list[tuple[str, int, int]]:
    """(name, begin, end) of the fields in a row of a .dbf file, by its head."""
    out, at, offset = [], 32, 1
    while at < len(head) and head[at] != 0x0D:
        out.append((head[at : at + 11].split(b"\0")[0].decode(encoding), offset, offset + head[at + 16]))
        offset += head[at + 16]
        at += 32
    return out


def shape(body: bytes) -> tuple[str | None, np.ndarray, np.ndarray]:
    """Kind, sizes of the parts, and points of one record's content."""
    (code,) = struct.unpack_from("<i", body)
    kind = KINDS.get(code % 10) if code else None
    if kind == "Point":
        return kind, np.ones(1, np.int64), np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)
    if kind == "MultiPoint":
        (n,) = struct.unpack_from("<i", body, 36)
        return kind, np.ones(n, np.int64), np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2)
    if kind:
        parts, n = struct.unpack_from("<2i", body, 36)
        first = np.frombuffer(body, "<i4", parts, 44)
        return kind, np.diff(first, append=n), np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    return None, np.zeros(0, np.int64), np.zeros((0, 2))


def batch(stem: str, numbers: list[int], bodies: list[bytes], rows: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    shapes = [shape(b) for b in bodies]
    sizes = np.concatenate([s[1] for s in shapes]) if shapes else np.zeros(0, np.int64)
    points = np.concatenate([s[2] for s in shapes]) if shapes else np.zeros((0, 2))
    ends = lambda counts: pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["lon", "lat"])
    parts = pa.ListArray.from_arrays(ends([len(s[1]) for s in shapes]), pa.ListArray.from_arrays(ends(sizes), flat))
    columns = [pa.array([stem] * len(shapes)), pa.array(numbers, pa.int32()), pa.array([s[0] for s in shapes], pa.string()), parts, pa.array(rows, pa.map_(pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["file", "number", "kind", "parts", "attributes"])


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.encoding = options["path"], options.get("encoding", "latin-1")
        self.records = int(options.get("records", RECORDS))
        self.columns = [c.strip() for c in options["columns"].split(",")] if "columns" in options else None

    def partitions(self) -> list[Records]:
        """A partition for each range of records; only names and sizes of files are read here."""
        system, out = opened(self.path)[0], []
        found = [(p, None, v) for names in [listed(self.path, ".shp", ".shx", ".dbf")] for p, v in stems(names).items()]
        for z in listed(self.path, ".zip"):
            with zipfile.ZipFile(system.open_input_file(z)) as inside:
                found += [(z, stem, v) for stem, v in stems(inside.namelist()).items()]
                sizes = {i.filename: i.file_size for i in inside.infolist()}
                out += [Records(z, stem, v, a, b) for p, stem, v in found if p == z for a, b in self.ranges(sizes[v["shx"]] if "shx" in v else None)]
        for stem, member, endings in found:
            if member is None:
                size = system.get_file_info(endings["shx"]).size if "shx" in endings else None
                out += [Records(stem, None, endings, a, b) for a, b in self.ranges(size)]
        return out or [Records(self.path, None, {}, 0, 0)]

    def ranges(self, size: int | None) -> list[tuple[int, int | None]]:
        """Ranges of the records that an index of so many bytes has."""
        if size is None:
            return [(0, None)]
        n = (size - 100) // 8
        step = max(self.records, -(-n // TASKS))
        return [(a, min(n, a + step)) for a in range(0, n, step)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.endings:
            return
        system, holder = opened(self.path)[0], []
        stem = f"{part.path}/{part.member}" if part.member is not None else part.path
        shp, shx, dbf = (part.open(e, system, holder) for e in ("shp", "shx", "dbf"))
        head = dbf.read(32) if dbf else b""
        count, start, width = struct.unpack_from("<IHH", head, 4) if dbf else (0, 0, 0)
        known = fields(head + dbf.read(start - 32), self.encoding) if dbf else []
        known = [f for f in known if self.columns is None or f[0] in self.columns]
        for first, bodies in self.bodies(shp, shx, part):
            rows: list[list | None] = [[]] * len(bodies)
            if first < count:
                dbf.seek(start + first * width)
                data = dbf.read(min(len(bodies), count - first) * width)
                texts = [data[i : i + width] for i in range(0, len(data), width)]
                rows[: len(texts)] = [None if t[:1] == b"*" else [(n, t[a:b].decode(self.encoding, "replace").strip()) for n, a, b in known] for t in texts]
            kept = [i for i, r in enumerate(rows) if r is not None]
            yield batch(stem, [first + i for i in kept], [bodies[i] for i in kept], [rows[i] for i in kept])

    @staticmethod
    def bodies(shp: BinaryIO, shx: BinaryIO | None, part: Records) -> Iterator[tuple[int, list[bytes]]]:
        """The number of the first record, and the contents of some; by the index, or one after the other."""
        if part.last is not None:
            shx.seek(100 + 8 * part.first)
            index = np.frombuffer(shx.read(8 * (part.last - part.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
            for low in range(0, len(index), AT_ONCE):
                some, out = index[low : low + AT_ONCE], []
                for place, size in some.tolist():
                    shp.seek(place + 8)
                    out.append(shp.read(size))
                yield part.first + low, out
            return
        shp.seek(100)
        number, out = 0, []
        while len(head := shp.read(8)) == 8:
            out.append(shp.read(2 * struct.unpack(">i", head[4:])[0]))
            if len(out) == AT_ONCE:
                yield number, out
                number, out = number + len(out), []
        yield number, out


class ShapefileSource(DataSource):
    """Options: `records` to a task (at least; a file has TASKS tasks at most), `encoding` of the attributes, `columns` (names of the attributes to read; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)


def read_shapefiles(spark: SparkSession, path: str, encoding: str = "latin-1", records: int = RECORDS, columns: list[str] | None = None) -> DataFrame:
    """(file, number, kind, parts, attributes) of all records of the shapefiles of a folder, a zip, or a folder of zips."""
    spark.dataSource.register(ShapefileSource)
    options = {"encoding": encoding, "records": records} | ({"columns": ",".join(columns)} if columns is not None else {})
    return spark.read.format("shapefile").options(**options).load(path)


def encoded(code: int, parts: list[list[dict]]) -> bytes:
    """The content of one record; without parts, a null shape."""
    points = np.array([(p["lon"], p["lat"]) for part in parts or [] for p in part], "<f8").reshape(-1, 2)
    if not len(points):
        return struct.pack("<i", 0)
    if code == 1:
        return struct.pack("<i", 1) + points[0].tobytes()
    box = struct.pack("<4d", *points.min(axis=0), *points.max(axis=0))
    first = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
    return struct.pack("<i", code) + box + struct.pack("<2i", len(parts), len(points)) + first.tobytes() + points.tobytes()


def file_head(size: int, code: int, box: list[float]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, code) + struct.pack("<8d", *box, 0, 0, 0, 0)


def write_shapefiles(df: DataFrame, folder: str, kind: str, attributes: list[str], parts: str = "parts", width: int = 80, encoding: str = "latin-1") -> list[str]:
    """Writes a shapefile (.shp, .shx, .dbf) for each partition of a frame whose shapes are all of one kind; returns their names.

    Attributes are written as text of `width` bytes at most; names are cut to ten characters. Each task writes under a name of its own; those of
    tasks that ended well are given their last name when all have.
    """
    code = next(c for c, k in KINDS.items() if k == kind)
    columns = [(a, a[:10].encode(encoding)) for a in attributes]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, rows = [], []
        for b in batches:
            bodies += [encoded(code, p) for p in b[parts].to_pylist()]
            texts = [[("" if v is None else str(v)).encode(encoding, "replace")[:width].ljust(width) for v in b[a].to_pylist()] for a, _ in columns]
            rows += [b" " + b"".join(t) for t in zip(*texts, strict=True)] if columns else [b" "] * b.num_rows
        if not bodies:
            return
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}"
        points = [s[2] for s in map(shape, bodies) if len(s[2])]
        box = [*np.concatenate(points).min(axis=0), *np.concatenate(points).max(axis=0)] if points else [0.0] * 4
        sizes = np.array(list(map(len, bodies)), np.int64)
        places = 100 + np.cumsum(sizes + 8) - sizes - 8
        head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(columns), 1 + width * len(columns))
        contents = {
            "shp": b"".join([file_head(int(100 + (sizes + 8).sum()), code, box), *(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))]),
            "shx": file_head(100 + 8 * len(bodies), code, box) + np.stack((places // 2, sizes // 2), 1).astype(">i4").tobytes(),
            "dbf": head + b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for _, n in columns) + b"\r" + b"".join(rows) + b"\x1a",
        }
        own = f"{name}.{uuid.uuid4().hex}"
        for ending, content in contents.items():
            with system.open_output_stream(f"{path}/{own}.{ending}.tmp") as out:
                out.write(content)
        yield pa.RecordBatch.from_arrays([pa.array([own])], ["name"])

    done = [r[0] for r in df.select(parts, *attributes).mapInArrow(write, "name string").collect()]  # a name for each partition
    system, path = opened(folder)
    for own in done:
        for ending in ("dbf", "shx", "shp"):
            system.move(f"{path}/{own}.{ending}.tmp", f"{path}/{own.split('.')[0]}.{ending}")
    return sorted(own.split(".")[0] for own in done)
