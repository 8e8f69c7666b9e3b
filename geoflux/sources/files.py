"""File formats that are parsed whole: GeoPackage, Shapefile, LAS.

Spark lists and reads the files (any file system it knows), one row a file;
Arrow batches of parsed rows come back. A file is one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jvm
from ..functions import call, register
from ..ship import ship

BATCH = 4096
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


def _listed(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(paths)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[str]) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], _ARROW[k]) for i, k in enumerate(kinds)], names=names)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], _ARROW[k]) for i, k in enumerate(kinds)], names=names)


def _parsed(files: DataFrame, parse: Any, columns: list[tuple[str, str]]) -> DataFrame:
    names, kinds = [c for c, _ in columns], [k for _, k in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                args = [batch.column(c)[i].as_py() for c in range(batch.num_columns)]
                yield from _batches(parse(*args), names, kinds)

    return files.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in columns))


# ---- GeoPackage


def _open(content: bytes):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def _gpkg_columns(content: bytes, layer: str | None) -> tuple[str, str, int, list[tuple[str, str]]]:
    db = _open(content)
    found = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
    for table, geom, srid in found:
        if layer is None or table == layer:
            # Fixed storage classes of SQLite by the first letters of a declared type.
            kinds = {"INT": "bigint", "MED": "bigint", "SMA": "bigint", "TIN": "bigint", "DOU": "double", "REA": "double", "FLO": "double", "BLO": "binary", "BOO": "bigint"}
            columns = [(c[1], "binary" if c[1] == geom else kinds.get(c[2][:3].upper(), "string")) for c in db.execute(f'PRAGMA table_info("{table}")')]
            return table, geom, srid, columns
    raise ValueError(f"no layer {layer!r} in the GeoPackage")


def geopackage(spark: SparkSession, paths: str | list[str], layer: str | None = None) -> DataFrame:
    """A layer (the first by name unless given) of one or more GeoPackages of one structure."""
    register(ship(spark))
    files = _listed(spark, paths, "*.gpkg")
    table, geom, srid, columns = _gpkg_columns(files.select("content").head()[0], layer)

    def parse(content: bytes) -> Iterator[tuple]:
        sizes = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}  # fixed sizes of the envelope in a geometry's header
        at = [c for c, _ in columns].index(geom)
        text = [i for i, (_, k) in enumerate(columns) if k == "string"]
        for row in _open(content).execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c, _ in columns)} FROM "{table}"'):
            row = list(row)
            if row[at] is not None:
                row[at] = row[at][8 + sizes[row[at][3] >> 1 & 7] :]
            for i in text:
                row[i] = None if row[i] is None else str(row[i])
            yield tuple(row)

    out = _parsed(files.select("content"), parse, columns)
    return out.withColumn(geom, call("st_setsrid", F.col(f"`{geom}`"), F.lit(max(0, srid)))) if srid > 0 else out


# ---- Shapefile


def _dbf_fields(dbf: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("latin-1")
        kind, length, places = chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]
        fields.append((name, "string" if kind not in "NFL" else "boolean" if kind == "L" else "double" if places or kind == "F" else "bigint", length))
        at += 32
    return n, head, size, fields


def _dbf_rows(dbf: bytes) -> Iterator[tuple]:
    n, head, size, fields = _dbf_fields(dbf)
    for i in range(n):
        at, row = head + i * size + 1, []
        for _, kind, length in fields:
            raw = dbf[at : at + length].decode("utf-8", "replace").strip()
            at += length
            row.append(None if not raw else int(float(raw)) if kind == "bigint" else float(raw) if kind == "double" else raw in "YyTt" if kind == "boolean" else raw)
        yield tuple(row)


def _shape(raw: bytes) -> bytes | None:
    """WKB of a record of points, multipoints, lines or polygons (Z and M are left out)."""
    kind = struct.unpack_from("<i", raw)[0] % 10
    if kind == 0:
        return None
    if kind == 1:
        return struct.pack("<BI", 1, 1) + raw[4:20]
    if kind == 8:
        n = struct.unpack_from("<i", raw, 36)[0]
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI", 1, 1) + raw[40 + 16 * i : 56 + 16 * i] for i in range(n))
    parts, n = struct.unpack_from("<ii", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    base = 44 + 4 * parts
    runs = [raw[base + 16 * a : base + 16 * b] for a, b in zip(starts, starts[1:], strict=False)]
    ring = lambda r: struct.pack("<I", len(r) // 16) + r
    if kind == 3:
        lines = [struct.pack("<BI", 1, 2) + ring(r) for r in runs]
        return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)
    polygons: list[list[bytes]] = []
    for r in runs:  # outer rings are clockwise, holes follow their outer ring
        c = struct.unpack(f"<{len(r) // 8}d", r)
        twice = sum(c[i] * c[i + 3] - c[i + 2] * c[i + 1] for i in range(0, len(c) - 2, 2))
        if twice <= 0 or not polygons:
            polygons.append([r])
        else:
            polygons[-1].append(r)
    made = [struct.pack("<BII", 1, 3, len(p)) + b"".join(map(ring, p)) for p in polygons]
    return made[0] if len(made) == 1 else struct.pack("<BII", 1, 6, len(made)) + b"".join(made)


def shapefile(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Attributes of the .dbf and ``geometry`` of the .shp; files of one structure."""
    register(ship(spark))
    paths = [paths] if isinstance(paths, str) else list(paths)
    stem = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    shp = _listed(spark, paths, "*.shp").select(stem.alias("stem"), F.col("content").alias("shp"))
    dbf = _listed(spark, [p[:-4] + ".dbf" if p.endswith(".shp") else p for p in paths], "*.dbf").select(stem.alias("stem"), F.col("content").alias("dbf"))
    head = jvm.static(spark, "geoflux.Files", "head", [spark._jsparkSession, "\n".join(p[:-4] + ".dbf" if p.endswith(".shp") else p for p in paths), ".dbf", 65_536])  # a header ends before
    fields = _dbf_fields(bytes(head))[3]

    def parse(shp: bytes, dbf: bytes) -> Iterator[tuple]:
        at = 100
        for row in _dbf_rows(dbf):
            size = struct.unpack_from(">i", shp, at + 4)[0] * 2
            yield (*row, _shape(shp[at + 8 : at + 8 + size]))
            at += 8 + size

    return _parsed(shp.join(dbf, "stem").select("shp", "dbf"), parse, [*[(n, k) for n, k, _ in fields], ("geometry", "binary")])


# ---- LAS

# Fixed layout of the point records 0 to 3 and 6 to 8: (name, offset, format).
_OLD = (("intensity", 12, "H"), ("classification", 15, "B"), ("scan_angle", 16, "b"), ("user_data", 17, "B"), ("point_source_id", 18, "H"))
_NEW = (("intensity", 12, "H"), ("classification", 16, "B"), ("user_data", 17, "B"), ("scan_angle", 18, "h"), ("point_source_id", 20, "H"))
_TIME = {1: 20, 3: 20, 6: 22, 7: 22, 8: 22}
_COLOUR = {2: 20, 3: 28, 7: 30, 8: 30}
LAS_COLUMNS = [
    ("x", "double"), ("y", "double"), ("z", "double"), ("intensity", "int"), ("return_number", "int"), ("number_of_returns", "int"), ("classification", "int"), ("scan_angle", "int"),
    ("user_data", "int"), ("point_source_id", "int"), ("gps_time", "double"), ("red", "int"), ("green", "int"), ("blue", "int"),
]


def _las(content: bytes) -> Iterator[pa.RecordBatch]:
    import numpy as np

    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, = struct.unpack_from("<I", content, 96)
    kind, size, n = content[104], *struct.unpack_from("<HI", content, 105)
    if kind & 0x80:
        raise ValueError("the file is compressed (LAZ); LAS is read")
    if content[25] >= 4 and n == 0:
        n, = struct.unpack_from("<Q", content, 247)
    sx, sy, sz, ox, oy, oz = struct.unpack_from("<6d", content, 131)
    raw = np.frombuffer(content, np.uint8, n * size, start).reshape(n, size)
    at = lambda o, f: np.ascontiguousarray(raw[:, o : o + np.dtype(f).itemsize]).view("<" + f)[:, 0]
    out = {"x": at(0, "i4") * sx + ox, "y": at(4, "i4") * sy + oy, "z": at(8, "i4") * sz + oz}
    flags = raw[:, 14]
    out["return_number"], out["number_of_returns"] = (flags & 15, flags >> 4) if kind >= 6 else (flags & 7, flags >> 3 & 7)
    sizes = {"H": "u2", "B": "u1", "b": "i1", "h": "i2"}
    for name, o, f in _NEW if kind >= 6 else _OLD:
        v = at(o, sizes[f])
        out[name] = v & 31 if name == "classification" and kind < 6 else v
    if kind in _TIME:
        out["gps_time"] = at(_TIME[kind], "f8")
    if kind in _COLOUR:
        for i, c in enumerate(("red", "green", "blue")):
            out[c] = at(_COLOUR[kind] + 2 * i, "u2")
    none = lambda k: pa.nulls(n, _ARROW[k])
    whole = pa.RecordBatch.from_arrays([pa.array(out[c]).cast(_ARROW[k]) if c in out else none(k) for c, k in LAS_COLUMNS], names=[c for c, _ in LAS_COLUMNS])
    for i in range(0, n, 65536):
        yield whole.slice(i, 65536)


def las(spark: SparkSession, paths: str | list[str], geometry: bool = True) -> DataFrame:
    """Points of LAS files with their attributes and, if asked for, ``geometry`` (POINT Z)."""
    register(ship(spark))
    files = _listed(spark, paths, "*.las").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0):
                yield from _las(c.as_py())

    out = files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in LAS_COLUMNS))
    return out.withColumn("geometry", call("st_pointz", "x", "y", "z")) if geometry else out


__all__ = ["geopackage", "las", "shapefile"]
