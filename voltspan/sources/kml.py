"""KML and KMZ: placemarks as rows with their folders, styles, attributes and geometries, and a writer of both.

A file is a task's work, as its styles may stand behind the placemarks that use them; of its elements it holds the styles and one placemark. Of a KMZ, each
.kml member is read.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.functions.wkb import GEOMETRY
from voltspan.sources.files import opened

SCHEMA = f"file string, member string, folders array<string>, name string, description string, stroke string, stroke_opacity double, stroke_width double, fill string, fill_opacity double, attributes map<string,string>, geometry {GEOMETRY.simpleString()}"
_SIMPLE = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))])
_ARROW = pa.schema([
    ("file", pa.string()), ("member", pa.string()), ("folders", pa.list_(pa.string())), ("name", pa.string()), ("description", pa.string()), ("stroke", pa.string()), ("stroke_opacity", pa.float64()), ("stroke_width", pa.float64()),
    ("fill", pa.string()), ("fill_opacity", pa.float64()), ("attributes", pa.map_(pa.string(), pa.string())), ("geometry", pa.struct([("kind", pa.string()), ("members", pa.list_(_SIMPLE))])),
])

#: Characters of a written file, and placemarks that are turned into rows or text at once.
FILE_BYTES, AT_ONCE = 8_000_000, 1_000


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _child(node: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    for n in names:
        node = next((c for c in node if _name(c) == n), None) if node is not None else None
    return node


def _text(node: ElementTree.Element | None, *names: str) -> str | None:
    found = _child(node, *names)
    return found.text.strip() if found is not None and found.text else None


def colour(value: str | None) -> tuple[str | None, float | None]:
    """aabbggrr as #rrggbb and an opacity to two places; null for anything else."""
    try:
        a, b, g, r = bytes.fromhex((value or "").removeprefix("#"))
    except ValueError:
        return None, None
    return f"#{r:02x}{g:02x}{b:02x}", round(a / 255, 2)


def _style(node: ElementTree.Element | None) -> dict:
    out = {}
    for key, tag in (("stroke", "LineStyle"), ("fill", "PolyStyle")):
        found, opacity = colour(_text(node, tag, "color"))
        out |= {key: found, f"{key}_opacity": opacity} if found else {}
    try:
        return out | {"stroke_width": float(_text(node, "LineStyle", "width"))}
    except (TypeError, ValueError):
        return out


def _places(text: str | None) -> list[dict]:
    out = []
    for triple in (text or "").split():
        try:
            lon, lat = map(float, triple.split(",")[:2])
        except ValueError:
            continue
        out.append({"lon": lon, "lat": lat})
    return out


def _geometry(node: ElementTree.Element) -> dict | None:
    """The geometry in a placemark: one, or a multi-geometry whose kind is its members' if they are of one."""
    kind = _name(node)
    if kind == "Point" or kind == "LineString":
        places = _places(_text(node, "coordinates"))
        return {"kind": kind, "members": [{"kind": kind, "parts": [places]}]} if places else None
    if kind == "Polygon":
        rings = [_places(_text(b, "LinearRing", "coordinates")) for b in node if _name(b) in ("outerBoundaryIs", "innerBoundaryIs")]
        order = [_name(b) == "innerBoundaryIs" for b in node if _name(b) in ("outerBoundaryIs", "innerBoundaryIs")]
        rings = [r for inner, r in sorted(zip(order, rings, strict=True), key=lambda x: x[0]) if r]
        return {"kind": kind, "members": [{"kind": kind, "parts": rings}]} if rings else None
    if kind == "MultiGeometry":
        members = [m for c in node if (g := _geometry(c)) for m in g["members"]]
        kinds = {m["kind"] for m in members}
        return {"kind": f"Multi{kinds.pop()}" if len(kinds) == 1 else "GeometryCollection", "members": members} if members else None
    return None


def _elements(source: BinaryIO) -> Iterator[tuple[str, ElementTree.Element, list[ElementTree.Element]]]:
    """Starts and ends of a document's elements, with those around them; an element in a container (or out of it) is let go when it has ended."""
    around: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            yield event, node, around
            around.append(node)
        else:
            around.pop()
            yield event, node, around
            if around and _name(around[-1]) in CONTAINERS and _name(node) != "name":
                around[-1].remove(node)


CONTAINERS = ("kml", "Document", "Folder")


def placemarks(data: bytes | Callable[[], BinaryIO]) -> Iterator[dict]:
    """The placemarks of a document, in order. A document that is no XML raises. It is gone through twice, first for its styles, and an element at a time; a
    function opens it anew each time."""
    source = data if callable(data) else lambda: io.BytesIO(data)
    styles: dict[str, ElementTree.Element] = {}
    names, inside = [], []  # of folders, which may have theirs behind their placemarks
    for event, node, _ in _elements(source()):
        if _name(node) == "Folder" and event == "start":
            inside.append(len(names))
            names.append("")
        elif _name(node) == "Folder":
            names[inside.pop()] = _text(node, "name") or ""
        elif event == "end" and _name(node) in ("Style", "StyleMap") and node.get("id"):
            styles[f"#{node.get('id')}"] = node

    def resolved(url: str | None, depth: int = 0) -> dict:
        node = styles.get(url or "")
        if node is None or depth > 4:
            return {}
        if _name(node) == "Style":
            return _style(node)
        pair = next((p for p in node if _name(p) == "Pair" and _text(p, "key") == "normal"), None)
        return resolved(_text(pair, "styleUrl"), depth + 1) | (_style(_child(pair, "Style")) if pair is not None else {})

    waiting, folders = iter(names), []
    for event, node, around in _elements(source()):
        if _name(node) == "Folder":
            folders = [*folders, next(waiting)] if event == "start" else folders[:-1]
        elif event == "end" and _name(node) == "Placemark" and all(_name(n) in CONTAINERS for n in around):
            extended = _child(node, "ExtendedData")
            attributes = {}
            for d in extended.iter() if extended is not None else ():
                if _name(d) == "Data":
                    attributes[d.get("name") or ""] = _text(d, "value") or ""
                elif _name(d) == "SimpleData":
                    attributes[d.get("name") or ""] = (d.text or "").strip()
            shape = next((g for c in node if (g := _geometry(c))), None)
            style = resolved(_text(node, "styleUrl")) | _style(_child(node, "Style"))
            yield {"folders": folders, "name": _text(node, "name"), "description": _text(node, "description"), "attributes": list(attributes.items()), "geometry": shape} | style


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """All placemarks of the .kml and .kmz files of a folder, or of one file; those without a geometry too, a null one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{kml,kmz,KML,KMZ}").option("recursiveFileLookup", True).load(path).select("path", "content")

    def documents(file: dict) -> Iterator[tuple[str | None, Callable[[], BinaryIO]]]:
        if not file["path"].lower().endswith(".kmz"):
            yield None, lambda: io.BytesIO(file["content"])
            return
        with zipfile.ZipFile(io.BytesIO(file["content"])) as z:
            for n in z.namelist():
                if n.lower().endswith(".kml"):
                    yield n, lambda n=n: z.open(n)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (file,) = batch.slice(i, 1).to_pylist()
                for member, opens in documents(file):
                    rows = ({"file": file["path"], "member": member} | p for p in placemarks(opens))
                    while some := list(islice(rows, AT_ONCE)):
                        yield pa.RecordBatch.from_pylist(some, _ARROW)

    return files.mapInArrow(parsed, SCHEMA)


def _coloured(value: str | None, opacity: float | None) -> str:
    r, g, b = bytes.fromhex((value or "#000000").removeprefix("#"))
    return f"{round(255 * (1 if opacity is None else opacity)):02x}{b:02x}{g:02x}{r:02x}"


def _written(member: dict) -> str:
    places = lambda ring: " ".join(f"{p['lon']!r},{p['lat']!r}" for p in ring)
    if member["kind"] == "Polygon":
        rings = [f"<LinearRing><coordinates>{places(r)}</coordinates></LinearRing>" for r in member["parts"]]
        return "<Polygon>" + "".join(f"<{t}BoundaryIs>{r}</{t}BoundaryIs>" for t, r in zip(["outer", *["inner"] * len(rings)], rings, strict=False)) + "</Polygon>"
    return f"<{member['kind']}><coordinates>{places(member['parts'][0])}</coordinates></{member['kind']}>"


def placemark(row: dict, attributes: list[str]) -> str:
    """A row of name, description, style and geometry (any of them may be missing) as an element; nulls are left out."""
    out = "".join(f"<{t}>{escape(str(row[t]))}</{t}>" for t in ("name", "description") if row.get(t) is not None)
    line = f"<color>{_coloured(row['stroke'], row.get('stroke_opacity'))}</color>" if row.get("stroke") else ""
    line += f"<width>{row['stroke_width']!r}</width>" if row.get("stroke_width") is not None else ""
    style = f"<LineStyle>{line}</LineStyle>" if line else ""
    style += f"<PolyStyle><color>{_coloured(row['fill'], row.get('fill_opacity'))}</color></PolyStyle>" if row.get("fill") else ""
    out += f"<Style>{style}</Style>" if style else ""
    data = "".join(f"<Data name={quoteattr(a)}><value>{escape(str(row[a]))}</value></Data>" for a in attributes if row[a] is not None)
    out += f"<ExtendedData>{data}</ExtendedData>" if data else ""
    shape = row.get("geometry")
    if shape and shape["members"]:
        inner = "".join(map(_written, shape["members"]))
        out += f"<MultiGeometry>{inner}</MultiGeometry>" if shape["kind"].startswith("Multi") or shape["kind"] == "GeometryCollection" else inner
    return f"<Placemark>{out}</Placemark>\n"


def write_kml(df: DataFrame, path: str, attributes: list[str], folder: str | None = None, zipped: bool = False, most: int = FILE_BYTES) -> int:
    """Writes the rows of each partition to .kml (or .kmz) files, placemarks in folders named by a column if one is given; returns the number of files. A
    partition's next file begins where one has `most` characters, so that a task holds no more, nor one that reads it. Files get their last names when all
    tasks have ended well."""

    def document(places: dict[str | None, list[str]]) -> bytes:
        body = "".join("".join(marks) if name is None else f"<Folder><name>{escape(str(name))}</name>\n{''.join(marks)}</Folder>\n" for name, marks in places.items())
        text = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n{body}</Document></kml>\n'.encode()
        if zipped:
            with zipfile.ZipFile(whole := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("doc.kml", text)
            text = whole.getvalue()
        return text

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str | None, list[str]]]:
        places, size = {}, 0
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                for row in batch.slice(low, AT_ONCE).to_pylist():
                    mark = placemark(row, attributes)
                    places.setdefault(row[folder] if folder else None, []).append(mark)
                    size += len(mark)
                    if size >= most:
                        yield places
                        places, size = {}, 0
        if places:
            yield places

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in parts(batches):
            system, at = opened(path)
            system.create_dir(at, recursive=True)
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.{'kmz' if zipped else 'kml'}"
            with system.open_output_stream(f"{at}/_tmp-{name}") as out:
                out.write(document(places))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    done = [r[0] for r in df.mapInArrow(write, "name string").collect()]  # a name for each file of FILE_BYTES
    system, at = opened(path)
    for name in done:
        system.move(f"{at}/_tmp-{name}", f"{at}/{name}")
    return len(done)
