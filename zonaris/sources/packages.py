"""Packages and feature collections: ZIP members under limits, GML and GeoJSON features, address XML, feature-info HTML, ZIP and tile sinks.

Readers take rows (path, content) as `spark.read.format("binaryFile")` gives them, so one file is the unit of parallel reading; every
reader has limits, and tells what it refused as rows instead of failing the job.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonaris.functions import numbers
from zonaris.functions.legal import arrow

#: Limits of an archive, chosen so that one fits into a worker: members, bytes of one member and of all, and unpacked bytes for each packed one, of
#: members above a floor (a deflated member of one repeated byte reaches 1000).
MEMBERS, MEMBER_BYTES, ALL_BYTES, RATIO, FLOOR = 2000, 64 << 20, 128 << 20, 100.0, 8 << 10
#: Bytes of members that go back to Spark at once.
BATCH_BYTES = 4 << 20
#: Limit of an XML document: elements.
ELEMENTS = 2_000_000
_s, _f = pa.string(), pa.float64()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file at `path`."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def safe_name(name: str) -> str | None:
    """A member's path inside its archive, or null where it is none: absolute, on a drive, through a parent, with a control character, or empty."""
    steps = re.split(r"[/\\]", name)
    if steps[0] == "" or ".." in steps or re.match(r"[A-Za-z]:", name) or re.search(r"[\x00-\x1f]", name):
        return None
    return "/".join(s for s in steps if s not in ("", ".")) or None


def members_of(raw: bytes, suffixes: Sequence[str] = ()) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(member, content, reason) of an archive: members with one of the suffixes, or a single row with the reason why it is refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError):
        yield "", None, "not_an_archive"
        return
    infos = z.infolist()
    if len(infos) > MEMBERS:
        yield "", None, "too_many_members"
        return
    total = 0
    for i in infos:
        name = safe_name(i.filename)
        if name is None:
            yield i.filename, None, "unsafe_path"
            continue
        if i.is_dir() or (suffixes and not name.lower().endswith(tuple(suffixes))):
            continue
        if i.file_size > MEMBER_BYTES:
            yield name, None, "member_too_large"
        elif i.file_size > FLOOR and i.file_size > RATIO * max(1, i.compress_size):
            yield name, None, "ratio_too_high"
        else:
            with z.open(i) as f:
                data = f.read(MEMBER_BYTES + 1)  # the header may lie about the size
            total += len(data)
            if len(data) > MEMBER_BYTES or total > ALL_BYTES:
                yield name, None, "archive_too_large"
                return
            yield name, data, None


def _unpacked(suffixes: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: (path, content) to (path, member, content, reason); archives are read one by one, and members go back in batches
    of about `BATCH_BYTES`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def made(held, batch=batch):
                at, members, contents, reasons = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(at)), pa.array(members, _s), pa.array(contents, pa.binary()), pa.array(reasons, _s)], names=["path", "member", "content", "reason"])

            for i, raw in enumerate(batch.column("content")):
                for member, content, reason in members_of(raw.as_py() or b"", suffixes):
                    held.append((i, member, content, reason))
                    size += len(content or b"")
                    if size >= BATCH_BYTES:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    return run


def unzip(files: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(path, member, content, reason) of ZIP files (path, content): one row for each member read or refused."""
    kind = f"path {files.schema['path'].dataType.simpleString()}, member string, content binary, reason string"
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_unpacked(suffixes), kind)


_local = lambda tag: tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _events(raw: bytes) -> Iterator[ElementTree.Element]:
    """Elements as they end; document types (entities) and documents with too many elements are refused."""
    if re.search(rb"<!DOCTYPE|<!ENTITY", raw[:4096]):
        raise ValueError("document_type")
    for n, (_, e) in enumerate(ElementTree.iterparse(io.BytesIO(raw))):
        if n > ELEMENTS:
            raise ValueError("too_many_elements")
        yield e


def _flat(e: ElementTree.Element, path: str, out: dict[str, str]) -> None:
    for child in e:
        name = f"{path}.{_local(child.tag)}" if path else _local(child.tag)
        if _local(child.tag) in ("Polygon", "MultiSurface", "Surface", "Point", "LineString"):
            continue
        if len(child):
            _flat(child, name, out)
        elif child.text and child.text.strip():
            out.setdefault(name, child.text.strip())


def gml_features(raw: bytes, tag: str, swap: bool) -> list[dict]:
    """Features of a GML document: id, kind, rings (flat x, y lists; swapped where the axes are north, east) and nested properties by dotted path."""
    out = []
    try:
        for e in _events(raw):
            if _local(e.tag) != tag:
                continue
            rings = []
            for p in e.iter():
                if _local(p.tag) == "posList" and p.text:
                    v = [float(x) for x in p.text.split()]
                    rings.append([c for i in range(0, len(v) - 1, 2) for c in ((v[i + 1], v[i]) if swap else (v[i], v[i + 1]))])
            props: dict[str, str] = {}
            _flat(e, "", props)
            ident = next((v for k, v in e.attrib.items() if _local(k) == "id"), None)
            out.append({"id": ident, "rings": rings, "props": list(props.items()), "reason": None})
            e.clear()
    except (ElementTree.ParseError, ValueError) as err:
        out.append({"id": None, "rings": [], "props": [], "reason": str(err) if isinstance(err, ValueError) and not isinstance(err, ElementTree.ParseError) else "not_well_formed"})
    return out


_feature = pa.list_(pa.struct([("id", _s), ("rings", pa.list_(pa.list_(_f))), ("props", pa.map_(_s, _s)), ("reason", _s)]))
_FEATURE = "array<struct<id:string,rings:array<array<double>>,props:map<string,string>,reason:string>>"


def read_gml(files: DataFrame, tag: str, swap: bool = False) -> DataFrame:
    """(path, id, shape, props, reason) of the elements `tag` of GML files (path, content)."""
    d = files.select("path", F.explode(arrow(lambda raw: gml_features(bytes(raw or b""), tag, swap), _FEATURE, _feature)("content")).alias("f"))
    return d.select("path", "f.id", F.col("f.rings").alias("shape"), "f.props", "f.reason")


def reprojected(shape: Column) -> Column:
    """Rings of longitude and latitude in the plane system 1992."""

    def plane(rings):
        if rings is None:
            return None
        out = []
        for r in rings:
            p = np.array(r, float).reshape(-1, 2)
            phi, lam = np.radians(p[:, 1]), np.radians(p[:, 0] - numbers.LON0)
            t = np.sinh(np.arctanh(np.sin(phi)) - numbers._E * np.arctanh(numbers._E * np.sin(phi)))
            xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
            north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(numbers.FORWARD, 1))
            east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(numbers.FORWARD, 1))
            k = numbers.SCALE * numbers.RADIUS
            out.append(np.column_stack([numbers.EAST + k * east, numbers.NORTH + k * north]).ravel().tolist())
        return out

    return arrow(plane, "array<array<double>>", pa.list_(pa.list_(_f)))(shape)


def read_elements(files: DataFrame, tag: str, fields: Sequence[str]) -> DataFrame:
    """(path, fields..., reason) of the elements `tag` of XML files (path, content), read element by element; a field is the text of the first
    descendant of that name."""

    def rows(raw):
        out = []
        try:
            for e in _events(bytes(raw or b"")):
                if _local(e.tag) == tag:
                    found = {_local(x.tag): (x.text or "").strip() for x in reversed(list(e.iter()))}
                    out.append({**{f: found.get(f) or None for f in fields}, "reason": None})
                    e.clear()
        except (ElementTree.ParseError, ValueError):
            out.append({**dict.fromkeys(fields), "reason": "not_well_formed"})
        return out

    names = [*fields, "reason"]
    kind = f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    work = arrow(rows, kind, pa.list_(pa.struct([(n, _s) for n in names])))
    return files.select("path", F.explode(work("content")).alias("e")).select("path", "e.*")


class _Tables(HTMLParser):
    """Rows of cells of every table; a nested table's rows are its own and not part of the outer cell."""

    def __init__(self):
        super().__init__()
        self.stack: list[list[list[str]]] = []
        self.tables: list[list[list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append([])
        elif self.stack and tag == "tr":
            self.stack[-1].append([])
        elif self.stack and tag in ("td", "th"):
            (self.stack[-1] or self.stack[-1].append([]) or self.stack[-1])[-1].append("")

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self.tables.append(self.stack.pop())

    def handle_data(self, data):
        if self.stack and self.stack[-1] and self.stack[-1][-1]:
            self.stack[-1][-1][-1] += data


def info_records(text: str | None) -> list[dict]:
    """Records of a feature-info answer: JSON features, else HTML tables. A table of two columns is one record of keys and values; a wider one has
    its keys in the first row and a record in each other row."""
    text = (text or "").strip()
    if text[:1] in "{[":
        try:
            data = json.loads(text)
        except ValueError:
            return []
        features = data.get("features", [data]) if isinstance(data, dict) else data
        return [{"pairs": [(str(k), None if v is None else str(v)) for k, v in (f.get("properties", f) or {}).items()]} for f in features if isinstance(f, dict)]
    p = _Tables()
    p.feed(text)
    p.close()
    out = []
    for t in [*p.tables, *p.stack]:
        rows = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in t]
        rows = [r for r in rows if any(r)]
        if rows and all(len(r) == 2 for r in rows):
            out.append({"pairs": list(dict((k, v) for k, v in rows if k).items())})
        elif len(rows) > 1:
            out += [{"pairs": list(dict(zip(rows[0], r, strict=False)).items())} for r in rows[1:]]
    return out


def feature_info(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, record, props) of the records of feature-info answers in HTML or JSON."""
    typ = pa.list_(pa.struct([("pairs", pa.map_(_s, _s))]))
    work = arrow(info_records, "array<struct<pairs:map<string,string>>>", typ)
    return answers.select(key, F.posexplode(work(text)).alias("record", "r")).select(key, "record", F.col("r.pairs").alias("props"))


def lookup_lines(raw: Column) -> Column:
    """Answers of the parcel protocol, `0` and then lines `id|commune|wkt`, as an array of structs; another first line gives null."""
    lines = F.split(F.trim(raw), r"\r?\n")
    cells = F.transform(F.filter(F.slice(lines, 2, 10000), lambda x: x != ""), lambda x: F.split(x, r"\|"))
    rows = F.transform(cells, lambda c: F.struct(F.get(c, 0).alias("id"), F.get(c, 1).alias("commune"), F.get(c, 2).alias("wkt")))
    return F.when(F.trim(lines[0]) == "0", rows)


def assembled_acts(features: DataFrame, documents: DataFrame, acts: DataFrame, act: str) -> DataFrame:
    """(act, title, zones, documents, complete) of acts with their features and documents, joined by reference; an act without one of the two
    is kept and told as not complete. Zones are counted by layer, so no act's features are gathered."""
    f = features.groupBy(act).agg(F.count("*").alias("zones"), F.countDistinct("layer").alias("layers"))
    d = documents.groupBy(act).agg(F.count("*").alias("documents"))
    out = acts.join(f, act, "left").join(d, act, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*acts.columns, zero("zones"), zero("layers"), zero("documents"), (F.col("zones").isNotNull() & F.col("documents").isNotNull()).alias("complete"))


_manifest = pa.list_(pa.struct([("name", _s), ("n_bytes", pa.int64()), ("sha256", _s)]))


def zip_archives(rows: DataFrame, name: str, content: str, most: int) -> DataFrame:
    """(archive, content, manifest): rows packed into archives of about `most` bytes, always the same bytes for the same rows.

    Names are dealt by ranges, archives are runs of their order (`part` of the range, number of full archives before), members have a fixed date, and the
    manifest lists name, size and SHA-256. An archive holds at most `most` bytes and one further row.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    d = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).where("content is not null").repartitionByRange(n, "name").withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("number", F.floor(F.coalesce(F.sum(F.octet_length("content")).over(before), F.lit(0)) / most))

    def pack(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
        part, number = (k.as_py() for k in key)
        rows = sorted(zip(members.column("name").to_pylist(), members.column("content").to_pylist(), strict=True), key=lambda m: (m[0].encode(), m[1]))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:  # stored: the bytes do not depend on a compressor
            for member, data in rows:
                z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), data)
        manifest = [{"name": member, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()} for member, data in rows]
        return pa.table({"archive": pa.array([f"{part:05d}-{number:05d}"]), "content": pa.array([out.getvalue()], pa.binary()), "manifest": pa.array([manifest], _manifest)})

    # an archive's rows are a group of their own in Python: no batch holds several archives
    return d.groupBy("part", "number").applyInArrow(pack, "archive string, content binary, manifest array<struct<name:string,n_bytes:bigint,sha256:string>>")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    return _varint(number << 3 | kind) + (_varint(value) if kind == 0 else _varint(len(value)) + value)


def point_layer(name: str, points: Sequence[tuple[int, int, int]], extent: int = 4096) -> bytes:
    """A vector-tile layer (version 2) of points (id, x, y) in tile units."""
    zig = lambda v: v << 1 ^ v >> 31
    out = _field(15, 0, 2) + _field(1, 2, name.encode())
    for i, x, y in points:
        geometry = b"".join(_varint(v) for v in (9, zig(x), zig(y)))
        out += _field(2, 2, _field(1, 0, i) + _field(3, 0, 1) + _field(4, 2, geometry))
    return _field(3, 2, out + _field(5, 0, extent))


def vector_tiles(points: DataFrame, zoom: int, layer: str, most: int = 10_000) -> DataFrame:
    """(z, tx, ty, part, n, tile) of points (id, tx, ty, px, py, layer column): one encoded layer for each tile and run of at most `most` points, so a
    crowded tile is several rows, which concatenate to one tile."""
    w = Window.partitionBy("tx", "ty", layer).orderBy("id")
    d = points.withColumn("part", F.floor((F.row_number().over(w) - 1) / most))
    g = d.groupBy("tx", "ty", F.col(layer).alias("layer"), "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("id", "px", "py"))).alias("p"))
    encode = arrow(lambda name, p: point_layer(name, [(x["id"], x["px"], x["py"]) for x in p]), "binary", pa.binary())
    return g.select(F.lit(zoom).alias("z"), "tx", "ty", "layer", "part", "n", encode("layer", "p").alias("tile"))
