"""Readers and writers round trip."""

import json
import sqlite3
import struct

import pytest

from geoflux import functions as st
from geoflux.session import connect
from geoflux.sources import geoparquet


@pytest.fixture(scope="module")
def ctx(spark):
    return connect(spark)


@pytest.fixture
def places(ctx):
    return ctx.sql("SELECT id, concat('n', id) AS name, st_setsrid(st_point(id, id * 2), 4326) AS geometry FROM range(10)")


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_geoparquet(ctx, places, tmp_path, version):
    path = str(tmp_path / "p.parquet")
    places.to_parquet(path, geoparquet_version=version)
    geo = geoparquet.metadata(ctx.spark, path)
    assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["geometry_types"] == ["Point"] and geo["columns"]["geometry"]["bbox"] == [0, 0, 9, 18]
    assert ("covering" in geo["columns"]["geometry"]) == (version == "1.1")
    got = ctx.read(path, bbox=(2, 0, 5, 100)) if version == "1.1" else ctx.read(path)
    assert sorted(r.id for r in got.df.collect()) == ([2, 3, 4, 5] if version == "1.1" else list(range(10)))
    assert got.df.selectExpr("st_crs(geometry) AS c").head().c == "OGC:CRS84"


def test_bbox_is_pushed_to_the_scan(ctx, places, tmp_path):
    path = str(tmp_path / "q.parquet")
    places.to_parquet(path, geoparquet_version="1.1")
    plan = ctx.read(path, bbox=(2, 0, 5, 100)).df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "geometry_bbox.xmin" in plan


def test_csv_json_geojson(ctx, places, tmp_path):
    places.to_csv(str(tmp_path / "a.csv"))
    assert ctx.read(str(tmp_path / "a.csv")).count() == 10
    places.to_json(str(tmp_path / "a.json"))
    assert ctx.read(str(tmp_path / "a.json")).count() == 10
    places.to_geojson(str(tmp_path / "a.geojson"))
    back = ctx.read.geojson(str(tmp_path / "a.geojson"), multiline=False)
    assert sorted((r.name, r.w) for r in back.df.selectExpr("name", "st_astext(geometry) AS w").collect())[3] == ("n3", "POINT(3 6)")
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    assert ctx.read(str(tmp_path / "c.geojson")).df.selectExpr("a", "st_area(geometry) AS s").collect() == [(1, 0.5)]
    with pytest.raises(ValueError):
        ctx.read(["a.csv", "b.json"])
    with pytest.raises(ValueError):
        ctx.read.csv("a.csv", delimiter="||")


def test_geopackage(ctx, tmp_path):
    path = tmp_path / "a.gpkg"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 'POINT', 3857, 0, 0)")
    db.execute("CREATE TABLE t (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, v DOUBLE)")
    for i in range(5):
        db.execute("INSERT INTO t VALUES (?, ?, ?, ?)", (i, b"GP\0\1" + struct.pack("<i", 3857) + struct.pack("<BIdd", 1, 1, i, 2 * i), f"n{i}", i / 2))
    db.commit()
    db.close()
    rows = ctx.read(str(path)).df.selectExpr("fid", "name", "v", "st_astext(geom) AS w", "st_srid(geom) AS s").orderBy("fid").collect()
    assert len(rows) == 5 and tuple(rows[3]) == (3, "n3", 1.5, "POINT(3 6)", 3857)


def test_shapefile(ctx, tmp_path):
    records = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, i, i + 0.5) for i in range(3))
    (tmp_path / "s.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8) + records)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(bytes([3, 24, 1, 1]) + struct.pack("<IHH", 3, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\r" + b"".join(b" " + f"p{i}".ljust(5).encode() for i in range(3)))
    rows = ctx.read(str(tmp_path / "s.shp")).df.selectExpr("NAME", "st_astext(geometry) AS w").orderBy("NAME").collect()
    assert [tuple(r) for r in rows] == [("p0", "POINT(0 0.5)"), ("p1", "POINT(1 1.5)"), ("p2", "POINT(2 2.5)")]


def test_las(ctx, tmp_path):
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HI", head, 94, 227, 227)
    head[104] = 1
    struct.pack_into("<HI", head, 105, 28, 4)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100, 200, 0)
    points = b"".join(struct.pack("<iiiHBBbBHd", i * 100, i * 200, i, 7 * i, 0b00010001, 2, -3, 0, 9, 1.5 * i) for i in range(4))
    (tmp_path / "a.las").write_bytes(bytes(head) + points)
    rows = ctx.read(str(tmp_path / "a.las")).df.orderBy("x").collect()
    assert (rows[2].x, rows[2].y, rows[2].intensity, rows[2].classification, rows[2].gps_time, rows[2].number_of_returns) == (102.0, 204.0, 14, 2, 3.0, 2)


def test_zarr_and_geotiff(ctx, tmp_path):
    import zlib

    import numpy as np

    a = tmp_path / "z.zarr" / "v"
    a.mkdir(parents=True)
    (a / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3, 4], "chunks": [2, 2], "dtype": "<i4", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "C", "filters": None}))
    (a / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["y", "x"]}))
    x = np.arange(12, dtype="<i4").reshape(3, 4)
    for i in range(2):
        for j in range(2):
            c = np.zeros((2, 2), "<i4")
            part = x[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]
            c[: part.shape[0], : part.shape[1]] = part
            (a / f"{i}.{j}").write_bytes(zlib.compress(c.tobytes()))
    rows = ctx.read(str(tmp_path / "z.zarr")).df.collect()
    assert sum(np.frombuffer(r.data, "<i4").sum() for r in rows) == x.sum() and {tuple(r.shape) for r in rows} == {(2, 2), (1, 2)}
    tif = ctx.spark.sql("SELECT rs_asgeotiff(rs_example(), 'deflate') AS b").head().b
    (tmp_path / "e.tif").write_bytes(tif)
    for lazy in (False, True):
        r = ctx.read(str(tmp_path / "e.tif"), lazy=lazy).df.selectExpr("rs_width(rast) AS w", "rs_srid(rast) AS s", "rs_value(rs_setcrs(rast, '0'), st_point(60, 95), 2) AS v", "rs_bandpath(rast) AS p").head()
        assert (r.w, r.s, r.v) == (64, 4326, 2.0) and (r.p is not None) == lazy


def test_random_geometry(ctx):
    df = ctx.sql("""SELECT * FROM sd_random_geometry('{"geom_type": "Polygon", "num_rows": 20, "hole_rate": 1.0}')""").df
    assert df.count() == 20 and df.selectExpr("bool_and(st_isvalid(geometry)) AS v", "min(st_nrings(geometry)) AS n").head() == (True, 2)


def test_geoparquet_scan_is_pruned_by_filters(spark, tmp_path):
    st.register(spark)
    path = str(tmp_path / "pruned")
    points = spark.range(4000).selectExpr("id", "st_point(id % 200, cast(id / 200 as int)) AS geometry").repartitionByRange(4, "id")
    geoparquet.write(points, path, geoparquet_version="1.1")
    for text, rows in (
        ("st_intersects(geometry, st_geomfromtext('POLYGON((2 3,7 3,7 9,2 9,2 3))', 'OGC:CRS84'))", 42), ("st_within(geometry, st_geomfromtext('POLYGON((2 3,7 3,7 9,2 9,2 3))', 'OGC:CRS84'))", 20),
        ("st_dwithin(geometry, st_point(5, 5, 'OGC:CRS84'), 1)", 5), ("st_distance(geometry, st_point(5, 5, 'OGC:CRS84')) < 1.5", 9), ("st_contains(st_geomfromtext('POLYGON((2 3,7 3,7 9,2 9,2 3))', 'OGC:CRS84'), geometry) AND id > 5", 20),
    ):
        df = geoparquet.read(spark, path, geometry_columns={"geometry": {"crs": "OGC:CRS84"}}).where(text)
        plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
        assert df.count() == rows and "LessThanOrEqual(geometry_bbox.xmin" in plan and "st_geomfromtext" not in plan and "st_point" not in plan
    plain = geoparquet.read(spark, path).select("id", "geometry")._jdf.queryExecution().executedPlan().toString()
    assert "geometry_bbox" not in plain and "geoflux_covered" not in plain


def test_geoparquet_metadata_of_several_files(spark, tmp_path):
    st.register(spark)
    one, two, three = (str(tmp_path / x) for x in ("a", "b", "c"))
    geoparquet.write(spark.sql("SELECT st_point(1, 2, 'EPSG:3857') AS geometry"), one, geoparquet_version="1.1")
    geoparquet.write(spark.sql("SELECT st_geomfromtext('LINESTRING(3 4,5 9)', 'EPSG:3857') AS geometry"), two)
    geoparquet.write(spark.sql("SELECT st_point(1, 2) AS geometry"), three)
    column = geoparquet.metadata(spark, [one, two])["columns"]["geometry"]
    assert column["bbox"] == [1, 2, 5, 9] and column["geometry_types"] == ["LineString", "Point"] and "covering" not in column
    assert geoparquet.read(spark, [one, two]).selectExpr("st_srid(geometry) AS s").distinct().collect()[0].s == 3857
    with pytest.raises(ValueError):
        geoparquet.read(spark, [one, three])
    with pytest.raises(ValueError):
        geoparquet.write(spark.sql("SELECT st_point(1, 2) AS geometry"), str(tmp_path / "d"), geoparquet_version="2.0")
