"""GeoParquet 1.0 and 1.1: Spark's own Parquet scan and writer, with the geo entry of the footers."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jvm
from ..functions import call, register

#: Reference system of the format's default.
DEFAULT_CRS = "OGC:CRS84"


def metadata(spark: SparkSession, paths: str | list[str]) -> dict | None:
    """The geo entries of all Parquet files under the paths as one, or None if none has any.

    Footers are read by Spark's executors and equal entries are sent once.
    Columns must agree in encoding, reference system and edges; bounds and
    kinds of geometries are united; a covering that some file lacks is none.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    register(spark)
    entries = [json.loads(e) if e else None for e in jvm.static(spark, "geoflux.GeoParquet", "entries", [spark._jsparkSession, "\n".join(files)])]
    with_geo = [e for e in entries if e]
    if not with_geo:
        return None
    out = json.loads(json.dumps(with_geo[0]))
    for entry in with_geo[1:]:
        for name, column in entry["columns"].items():
            have = out["columns"].setdefault(name, json.loads(json.dumps(column)))
            for key, default in (("encoding", "WKB"), ("crs", DEFAULT_CRS), ("edges", "planar")):
                if have.get(key, default) != column.get(key, default):
                    raise ValueError(f"files differ in the {key} of column {name}")
            have["geometry_types"] = sorted({*have.get("geometry_types", []), *column.get("geometry_types", [])}) if have.get("geometry_types") and column.get("geometry_types") else []
            a, b = have.get("bbox"), column.get("bbox")
            half = len(a) // 2 if a and b and len(a) == len(b) else 0
            have["bbox"] = [*map(min, a[:half], b[:half]), *map(max, a[half:], b[half:])] if half else None
            if have.get("covering") != column.get("covering"):
                have.pop("covering", None)
    if len(with_geo) < len(entries):
        for column in out["columns"].values():
            column.pop("covering", None)
            column["bbox"] = None
    return out


def _crs(entry: dict) -> str | None:
    crs = entry.get("crs", DEFAULT_CRS)
    if isinstance(crs, dict):
        code = crs.get("id")
        if not code:
            raise ValueError(f"the reference system {crs.get('name')!r} has no authority and code; name one by geometry_columns")
        return f"{code['authority']}:{code['code']}"
    return crs


def read(spark: SparkSession, paths: str | list[str], geometry_columns: dict | None = None, validate: bool = False, bbox: tuple | None = None, options: dict | None = None) -> DataFrame:
    """A scan whose geometry columns carry their reference system and edges.

    ``geometry_columns`` (name to ``{"crs": ..., "edges": ...}``) adds to or
    overrides the footers. ``validate`` checks every value. ``bbox`` (xmin,
    ymin, xmax, ymax) keeps the rows whose geometry intersects it; with a
    covering column its numbers are compared first, which Parquet statistics
    answer for whole row groups.
    """
    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.options(**(options or {})).parquet(*paths)
    geo = metadata(spark, paths) or {"columns": {}}
    columns = {**geo["columns"], **{k: {**geo["columns"].get(k, {"crs": None}), **v} for k, v in (geometry_columns or {}).items()}}
    if bbox is not None:
        name = geo.get("primary_column") or next(iter(columns))
        cover = columns[name].get("covering", {}).get("bbox")
        if cover:
            at = {k: F.col(".".join(f"`{p}`" for p in v)) for k, v in cover.items()}
            df = df.filter((at["xmin"] <= bbox[2]) & (at["xmax"] >= bbox[0]) & (at["ymin"] <= bbox[3]) & (at["ymax"] >= bbox[1]))
    made: dict[str, Column] = {}
    for name, entry in columns.items():
        if name not in df.columns:
            continue
        c = F.col(f"`{name}`")
        cover = entry.get("covering", {}).get("bbox")
        if cover and entry.get("edges") != "spherical":
            # The planner compares these columns wherever the geometry is held against a constant, and reads them only there.
            c = call("geoflux_covered", c, *[F.col(".".join(f"`{p}`" for p in cover[k])).cast("double") for k in ("xmin", "ymin", "xmax", "ymax")])
        if validate:
            c = call("st_geomfromwkb", c)
        if crs := _crs(entry):
            c = call("st_setcrs", c, F.lit(crs))
        if entry.get("edges") == "spherical":
            c = call("st_togeography", c)
        made[name] = c
    out = df.withColumns(made) if made else df
    if bbox is not None:
        crs = _crs(columns[name])
        box = call("st_geomfromtext", F.lit(f"POLYGON(({bbox[0]} {bbox[1]},{bbox[2]} {bbox[1]},{bbox[2]} {bbox[3]},{bbox[0]} {bbox[3]},{bbox[0]} {bbox[1]}))"), *([F.lit(crs)] if crs else []))
        out = out.filter(call("st_intersects", call("st_togeometry", F.col(f"`{name}`")), box))
    return out


def write(df: DataFrame, path: str, geometry: str | list[str] | None = None, geoparquet_version: str = "1.0", partition_by: list[str] | None = None, sort_by: list[str] | None = None,
          overwrite_bbox_columns: bool = False, single_file_output: bool | None = None, compression: str = "snappy", max_row_group_size: int | None = None, mode: str = "errorifexists") -> None:
    """Writes GeoParquet. Version 1.1 adds a covering ``<column>_bbox`` column; ``none`` writes plain Parquet.

    Geometry columns are those named, or binary columns called geometry, geom
    or like them. One pass finds their kinds, bounds and reference system.
    """
    spark = register(df.sparkSession)
    if geoparquet_version not in ("1.0", "1.1", "none"):
        raise ValueError(f"not a version of GeoParquet that is written: {geoparquet_version}")
    names = [geometry] if isinstance(geometry, str) else geometry
    if names is None:
        names = [f.name for f in df.schema if f.dataType.typeName() == "binary" and f.name.lower().startswith(("geom", "geog", "wkb"))]
    if sort_by:
        df = df.repartitionByRange(*[F.expr(f"geoflux_bounds(`{c}`).xmin") if c in names else F.col(c) for c in sort_by]).sortWithinPartitions(*[F.expr(f"geoflux_bounds(`{c}`).xmin") if c in names else F.col(c) for c in sort_by])
    entry: dict[str, Any] = {"version": "1.1.0" if geoparquet_version == "1.1" else "1.0.0", "primary_column": names[0] if names else None, "columns": {}}
    if geoparquet_version != "none" and names:
        asked = []
        for n in names:
            g = F.col(f"`{n}`")
            b = call("geoflux_bounds", g)
            asked += [F.collect_set(call("st_geometrytype", g)), F.min(b.xmin), F.min(b.ymin), F.max(b.xmax), F.max(b.ymax), F.min(call("st_crs", g)), F.max(call("st_crs", g)), F.first(g, ignorenulls=True)]
        found = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(asked)]).head()
        for i, n in enumerate(names):
            kinds, x0, y0, x1, y1, crs, other, sample = found[8 * i : 8 * i + 8]
            if crs != other:
                raise ValueError(f"column {n} mixes reference systems")
            column: dict[str, Any] = {"encoding": "WKB", "geometry_types": sorted(k.removeprefix("ST_") for k in kinds)}
            if x0 is not None:
                column["bbox"] = [x0, y0, x1, y1]
            if crs is None:
                column["crs"] = None
            elif crs != DEFAULT_CRS:
                authority, _, code = crs.partition(":")
                column["crs"] = {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "ProjectedCRS", "name": crs, "id": {"authority": authority, "code": int(code)}}
            if sample is not None and len(sample) > 9 and sample[4] & 0x20 and sample[8] & 0x40:
                column["edges"] = "spherical"
            if geoparquet_version == "1.1":
                box = f"{n}_bbox"
                if box in df.columns and not overwrite_bbox_columns:
                    raise ValueError(f"column {box} exists; overwrite_bbox_columns replaces it")
                df = df.withColumn(box, call("geoflux_bounds", F.col(f"`{n}`")))
                column["covering"] = {"bbox": {k: [box, k] for k in ("xmin", "ymin", "xmax", "ymax")}}
            entry["columns"][n] = column
        df = df.withColumns({n: call("st_asbinary", F.col(f"`{n}`")) for n in names})
    if single_file_output or (single_file_output is None and path.endswith(".parquet") and not partition_by):
        df = df.coalesce(1)
    plain = geoparquet_version == "none" or not names
    if not plain:
        spark.sparkContext._jvm.java.lang.Thread.currentThread().setContextClassLoader(jvm.loader(spark))
    w = df.write.format("parquet" if plain else "geoflux.GeoParquet").mode(mode).option("compression", compression)
    if not plain:
        w = w.option("geo", json.dumps(entry))
    if max_row_group_size:
        w = w.option("parquet.block.row.count.limit", max_row_group_size)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
