"""The registered spatial and relational queries, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as st
from .operators import distance_join, knn_join, spatial_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def put(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            st.register(spark)
            return fn(spark, d)

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return put


def both(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL that Spark and the oracle share, or nearly share."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        st.register(spark)
        # Tables are named in place: views of one folder would not outlive a call with another.
        import re

        return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} parquet.`{d}/{m[2]}.parquet`", text))

    QUERIES[name] = run
    ORACLES[name] = oracle or text


# ---- fixtures made of the tables: points of customers and suppliers, boxes of nations

POINTS = "SELECT c_custkey AS id, c_nationkey, c_acctbal AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y FROM customer"
SUPPLIERS = "SELECT s_suppkey AS sid, s_acctbal AS sx, CAST(s_suppkey * 10 AS DOUBLE) AS sy FROM supplier"
ZONES = "SELECT n_nationkey, n_name, (n_nationkey % 5) * 2000.0 - 1000 AS x0, (n_nationkey % 5) * 2000.0 + 1000 AS x1, floor(n_nationkey / 5) * 200.0 AS y0, floor(n_nationkey / 5) * 200.0 + 200 AS y1 FROM nation"
INSIDE = "x > x0 AND x < x1 AND y > y0 AND y < y1"


def points(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    return c.withColumn("geometry", st.st_point("x", "y"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_acctbal").alias("sx"), (F.col("s_suppkey") * 10).cast("double").alias("sy"))
    return s.withColumn("geometry", st.st_point("sx", "sy"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", (k % 5 * 2000.0 - 1000).alias("x0"), (k % 5 * 2000.0 + 1000).alias("x1"), (F.floor(k / 5) * 200.0).alias("y0"), (F.floor(k / 5) * 200.0 + 200).alias("y1"))
    return n.withColumn("geometry", st.st_geomfromtext(F.format_string("POLYGON((%s %s,%s %s,%s %s,%s %s,%s %s))", *[F.col(c) for c in "x0 y0 x1 y0 x1 y1 x0 y1 x0 y0".split()])))


# ---- joins


@query(f"SELECT n_name, count(*) AS n_points FROM ({ZONES}) z JOIN ({POINTS}) p ON {INSIDE} GROUP BY n_name")
def point_in_zone_count(spark, d):
    z, p = zones(spark, d).select("n_name", "geometry"), points(spark, d).select("id", "geometry")
    return spatial_join(z, p, "contains").groupBy("n_name").agg(F.count("*").alias("n_points"))


@query(f"SELECT id, n_nationkey FROM ({POINTS}) p JOIN ({ZONES}) z ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
def point_in_zone_grid(spark, d):
    """The grid join itself, whatever the sizes: boxes meet in cells."""
    z = zones(spark, d).select("n_nationkey", F.col("geometry").alias("zone"))
    return spatial_join(points(spark, d).select("id", "geometry"), z, "intersects", right_geom="zone", broadcast_bytes=0).select("id", "n_nationkey")


@query(f"SELECT id, sid FROM ({POINTS}) p JOIN ({SUPPLIERS}) s ON (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 2500")
def distance_join_50(spark, d):
    return distance_join(points(spark, d).select("id", "geometry"), suppliers(spark, d).select("sid", "geometry"), 50.0).select("id", "sid")


@query(f"SELECT id, sid FROM ({POINTS}) p JOIN ({SUPPLIERS}) s ON sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= c_nationkey * 4.0")
def distance_join_column(spark, d):
    p = points(spark, d).withColumn("r", F.col("c_nationkey") * 4.0).select("id", "r", "geometry")
    return distance_join(p, suppliers(spark, d).select("sid", "geometry"), "r").select("id", "sid")


_NEAR = f"SELECT id, sid, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS dist FROM ({POINTS}) p, ({SUPPLIERS}) s"


@query(f"SELECT id, sid, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid) AS r FROM ({_NEAR})) WHERE r <= 3")
def knn_join_3(spark, d):
    out = knn_join(points(spark, d).select("id", "geometry"), suppliers(spark, d).select("sid", "geometry"), 3, tie_break="sid", distance_col="dist")
    return out.select("id", "sid", F.round("dist", 6).alias("dist"))


@query(f"SELECT id, sid FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY dist) AS r FROM ({_NEAR} WHERE x > 5000)) WHERE r <= 2")
def knn_join_ties_prefilter(spark, d):
    """The filter is the feature: what a query row does not pass is not asked for."""
    out = knn_join(points(spark, d).where("x > 5000").select("id", "geometry"), suppliers(spark, d).select("sid", "geometry"), 2, ties=True)
    return out.select("id", "sid")


@query(f"SELECT id, sid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid) AS r FROM ({_NEAR})) WHERE r <= 2 AND sid % 2 = 0")
def knn_join_postfilter(spark, d):
    return knn_join(points(spark, d).select("id", "geometry"), suppliers(spark, d).select("sid", "geometry"), 2, tie_break="sid").where("sid % 2 = 0").select("id", "sid")


def _how(how: str, oracle: str, select: list[str]):
    def run(spark, d):
        z = zones(spark, d).select("n_nationkey", st.st_translate("geometry", F.lit(3000), F.lit(300)).alias("zone"))
        return spatial_join(points(spark, d).select("id", "geometry"), z, "within", right_geom="zone", how=how).select(*select)

    run.__name__ = f"spatial_{how}_join"
    query(oracle)(run)


# Moved to where some zones have no points, and some points no zone.
_MOVED = f"(SELECT n_nationkey, x0 + 3000 AS x0, x1 + 3000 AS x1, y0 + 300 AS y0, y1 + 300 AS y1 FROM ({ZONES}))"
_how("left", f"SELECT id, n_nationkey FROM ({POINTS}) p LEFT JOIN {_MOVED} z ON {INSIDE}", ["id", "n_nationkey"])
_how("right", f"SELECT id, n_nationkey FROM ({POINTS}) p RIGHT JOIN {_MOVED} z ON {INSIDE}", ["id", "n_nationkey"])
_how("full", f"SELECT id, n_nationkey FROM ({POINTS}) p FULL JOIN {_MOVED} z ON {INSIDE}", ["id", "n_nationkey"])
_how("left_semi", f"SELECT id FROM ({POINTS}) p WHERE EXISTS (SELECT 1 FROM {_MOVED} z WHERE {INSIDE})", ["id"])
_how("left_anti", f"SELECT id FROM ({POINTS}) p WHERE NOT EXISTS (SELECT 1 FROM {_MOVED} z WHERE {INSIDE})", ["id"])
_how("right_semi", f"SELECT n_nationkey FROM {_MOVED} z WHERE EXISTS (SELECT 1 FROM ({POINTS}) p WHERE {INSIDE})", ["n_nationkey"])
_how("right_anti", f"SELECT n_nationkey FROM {_MOVED} z WHERE NOT EXISTS (SELECT 1 FROM ({POINTS}) p WHERE {INSIDE})", ["n_nationkey"])
_how("left_mark", f"SELECT id, EXISTS (SELECT 1 FROM {_MOVED} z WHERE {INSIDE}) AS mark FROM ({POINTS}) p", ["id", "mark"])


# ---- the same joins as SQL, which the planner turns into joins on keys


def in_sql(name: str, text: str, oracle: str) -> None:
    def run(spark, d):
        from .session import connect

        for view, make in (("points", points), ("zones", zones), ("suppliers", suppliers)):
            make(spark, d).createOrReplaceTempView(f"geoflux_{view}")
        return connect(spark).sql(text).df

    run.__name__ = name
    query(oracle)(run)


in_sql("sql_intersects_join", "SELECT id, n_nationkey FROM geoflux_points p JOIN geoflux_zones z ON ST_Intersects(p.geometry, z.geometry)",
    f"SELECT id, n_nationkey FROM ({POINTS}) p JOIN ({ZONES}) z ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
in_sql("sql_left_join", "SELECT id, n_name FROM geoflux_points p LEFT JOIN geoflux_zones z ON ST_Within(p.geometry, z.geometry) AND z.n_nationkey <> p.c_nationkey",
    f"SELECT id, n_name FROM ({POINTS}) p LEFT JOIN ({ZONES}) z ON {INSIDE} AND n_nationkey <> c_nationkey")
in_sql("sql_anti_join", "SELECT id FROM geoflux_points p WHERE NOT EXISTS (SELECT 1 FROM geoflux_zones z WHERE ST_Contains(z.geometry, p.geometry))",
    f"SELECT id FROM ({POINTS}) p WHERE NOT EXISTS (SELECT 1 FROM ({ZONES}) z WHERE {INSIDE})")
in_sql("sql_touches_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM geoflux_zones a JOIN geoflux_zones b ON ST_Touches(a.geometry, b.geometry)",
    f"SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM ({ZONES}) a JOIN ({ZONES}) b ON a.n_nationkey <> b.n_nationkey AND abs(a.x0 - b.x0) <= 2000 AND abs(a.y0 - b.y0) <= 200")
in_sql("sql_dwithin_join", "SELECT id, sid FROM geoflux_points p JOIN geoflux_suppliers s ON ST_DWithin(p.geometry, s.geometry, 50)",
    f"SELECT id, sid FROM ({POINTS}) p JOIN ({SUPPLIERS}) s ON (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 2500")
in_sql("sql_distance_join", "SELECT id, sid FROM geoflux_points p, geoflux_suppliers s WHERE ST_Distance(p.geometry, s.geometry) < p.c_nationkey * 4.0",
    f"SELECT id, sid FROM ({POINTS}) p JOIN ({SUPPLIERS}) s ON sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) < c_nationkey * 4.0")
in_sql("sql_knn_join", "SELECT id, sid FROM geoflux_points p JOIN geoflux_suppliers s ON ST_KNN(p.geometry, s.geometry, 3, false)",
    f"SELECT id, sid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid) AS r FROM ({_NEAR})) WHERE r <= 3")
in_sql("sql_knn_join_filtered", "SELECT id, sid FROM geoflux_points p JOIN geoflux_suppliers s ON ST_KNN(p.geometry, s.geometry, 4, false) AND s.sx > 1000 AND p.x < 5000",
    f"SELECT id, sid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid) AS r FROM (SELECT id, x, sid, sx, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS dist FROM ({POINTS}) p, ({SUPPLIERS}) s)) WHERE r <= 4 AND sx > 1000 AND x < 5000")


@query(f"SELECT id, sid FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY dist) AS r FROM ({_NEAR})) WHERE r <= 2")
def knn_join_ties(spark, d):
    out = knn_join(points(spark, d).select("id", "geometry"), suppliers(spark, d).select("sid", "geometry"), 2, ties=True)
    return out.select("id", "sid")


# ---- functions on points and boxes, as expressions: name, frame, Spark columns, SQL

_FRAMES = {"p": (points, POINTS), "z": (zones, ZONES), "s": (suppliers, SUPPLIERS)}


def functions_on(name: str, frame: str, keys: str, spark_columns: dict[str, str], oracle_columns: dict[str, str]) -> None:
    make, source = _FRAMES[frame]

    def run(spark, d):
        return make(spark, d).selectExpr(*keys.split(), *[f"{e} AS {n}" for n, e in spark_columns.items()])

    run.__name__ = name
    query(f"SELECT {', '.join(keys.split())}, {', '.join(f'{e} AS {n}' for n, e in oracle_columns.items())} FROM ({source})")(run)


_G = "geometry"
functions_on("fn_point_accessors", "p", "id",
    {"px": "st_x(geometry)", "py": "st_y(geometry)", "kind": "st_geometrytype(geometry)", "dim": "st_dimension(geometry)", "n": "st_npoints(geometry)", "e": "st_isempty(geometry)", "z": "st_z(geometry)", "srid": "st_srid(st_setsrid(geometry, 3857))", "crs": "st_crs(st_setsrid(geometry, 4326))", "f": "st_zmflag(st_force3d(geometry))"},
    {"px": "x", "py": "y", "kind": "'ST_Point'", "dim": "0", "n": "1", "e": "false", "z": "NULL::DOUBLE", "srid": "3857", "crs": "'OGC:CRS84'", "f": "2"})
functions_on("fn_affine", "p", "id",
    {"tx": "round(st_x(st_translate(geometry, 1.5, -2)), 6)", "sy": "round(st_y(st_scale(geometry, 2, 3)), 6)", "rx": "round(st_x(st_rotate(geometry, 1.0)), 6)", "ry": "round(st_y(st_rotate(geometry, 1.0)), 6)", "ax": "round(st_x(st_affine(geometry, 1, 2, 3, 4, 5, 6)), 6)", "ay": "round(st_y(st_affine(geometry, 1, 2, 3, 4, 5, 6)), 6)", "fx": "st_x(st_flipcoordinates(geometry))"},
    {"tx": "round(x + 1.5, 6)", "sy": "round(y * 3, 6)", "rx": "round(x * cos(1.0) - y * sin(1.0), 6)", "ry": "round(x * sin(1.0) + y * cos(1.0), 6)", "ax": "round(x + 2 * y + 5, 6)", "ay": "round(3 * x + 4 * y + 6, 6)", "fx": "y"})
functions_on("fn_measures_of_boxes", "z", "n_nationkey",
    {"area": "st_area(geometry)", "per": "st_perimeter(geometry)", "len": "st_length(st_exteriorring(geometry))", "cx": "st_x(st_centroid(geometry))", "cy": "st_y(st_centroid(geometry))", "np": "st_npoints(geometry)", "rings": "st_nrings(geometry)", "xmin": "st_xmin(geometry)", "ymax": "st_ymax(geometry)", "v": "st_isvalid(geometry)", "c": "st_isclosed(st_boundary(geometry))", "e": "st_area(st_envelope(geometry))", "h": "st_area(st_convexhull(geometry))"},
    {"area": "(x1 - x0) * (y1 - y0)", "per": "2 * (x1 - x0 + y1 - y0)", "len": "2 * (x1 - x0 + y1 - y0)", "cx": "(x0 + x1) / 2", "cy": "(y0 + y1) / 2", "np": "5", "rings": "1", "xmin": "x0", "ymax": "y1", "v": "true", "c": "true", "e": "(x1 - x0) * (y1 - y0)", "h": "(x1 - x0) * (y1 - y0)"})
functions_on("fn_predicates", "p", "id",
    {k: f"st_{k}(st_geomfromtext('POLYGON((0 0,5000 0,5000 500,0 500,0 0))'), geometry)" for k in ("intersects", "contains", "covers", "disjoint", "touches")} | {"near": "st_dwithin(geometry, st_point(1000, 500), 800)", "rel": "st_relate(geometry, st_geomfromtext('POLYGON((0 0,5000 0,5000 500,0 500,0 0))'), 'T**FF*FF*')", "eq": "st_equals(geometry, st_point(x, y))"},
    {"intersects": "x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500", "contains": "x > 0 AND x < 5000 AND y > 0 AND y < 500", "covers": "x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500", "disjoint": "NOT (x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500)", "touches": "x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500 AND (x IN (0, 5000) OR y IN (0, 500))", "near": "(x - 1000) * (x - 1000) + (y - 500) * (y - 500) <= 640000", "rel": "false", "eq": "true"})
functions_on("fn_distance_azimuth", "p", "id",
    {"dist": "round(st_distance(geometry, st_point(0, 0)), 6)", "az": "round(st_azimuth(st_point(-1e4, -1), geometry), 6)", "far": "round(st_maxdistance(geometry, st_geomfromtext('LINESTRING(0 0,10 0)')), 6)", "line": "round(st_distance(geometry, st_geomfromtext('LINESTRING(0 -1e6,0 1e6)')), 6)", "geo": "round(st_distance(st_geogpoint(0, 0), st_geogpoint(x / 100, y / 20)), 2)"},
    {"dist": "round(sqrt(x * x + y * y), 6)", "az": "round(atan2(x + 10000, y + 1), 6)", "far": "round(greatest(sqrt(x * x + y * y), sqrt((x - 10) * (x - 10) + y * y)), 6)", "line": "round(abs(x), 6)",
     "geo": "round(2 * 6371010 * asin(sqrt(pow(sin(radians(y / 20) / 2), 2) + cos(radians(y / 20)) * pow(sin(radians(x / 100) / 2), 2))), 2)"})
functions_on("fn_formats", "z", "n_nationkey",
    {"wkt": "st_astext(st_point(n_nationkey, n_nationkey * 2))", "json": "st_asgeojson(st_point(n_nationkey + 0.5, 1.5))", "wkb": "hex(st_asbinary(st_point(0, 0)))", "back": "st_astext(st_geomfromwkb(st_asbinary(st_geomfromtext('LINESTRING Z(0 0 1,1 1 2)'))))", "ewkt": "st_srid(st_geomfromewkb(st_asewkb(st_geomfromewkt('SRID=3857;POINT(1 2)'))))"},
    {"wkt": "'POINT(' || n_nationkey || ' ' || n_nationkey * 2 || ')'", "json": "'{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || '.5,1.5]}'", "wkb": "'010100000000000000000000000000000000000000'", "back": "'LINESTRING Z(0 0 1,1 1 2)'", "ewkt": "3857"})
functions_on("fn_transform", "p", "id",
    {"mx": "round(st_x(st_transform(st_point(x / 100, y / 20, 4326), 'EPSG:3857')), 3)", "my": "round(st_y(st_transform(st_point(x / 100, y / 20, 4326), 'EPSG:3857')), 3)"},
    {"mx": "round(6378137 * radians(x / 100), 3)", "my": "round(6378137 * ln(tan(pi() / 4 + radians(y / 20) / 2)), 3)"})
functions_on("fn_overlay", "z", "n_nationkey",
    {"i": "round(st_area(st_intersection(geometry, st_translate(geometry, 500, 50))), 4)", "u": "round(st_area(st_union(geometry, st_translate(geometry, 500, 50))), 4)", "d": "round(st_area(st_difference(geometry, st_translate(geometry, 500, 50))), 4)", "s": "round(st_area(st_symdifference(geometry, st_translate(geometry, 500, 50))), 4)", "b": "round(st_area(st_buffer(st_centroid(geometry), 10)), 6)", "sq": "round(st_area(st_buffer(geometry, 10, 'join=mitre')), 4)", "v": "round(st_area(st_makevalid(st_geomfromtext('POLYGON((0 0,2 2,2 0,0 2,0 0))'))), 6)"},
    {"i": "(x1 - x0 - 500) * (y1 - y0 - 50)", "u": "2 * (x1 - x0) * (y1 - y0) - (x1 - x0 - 500) * (y1 - y0 - 50)", "d": "(x1 - x0) * (y1 - y0) - (x1 - x0 - 500) * (y1 - y0 - 50)", "s": "2 * ((x1 - x0) * (y1 - y0) - (x1 - x0 - 500) * (y1 - y0 - 50))", "b": "round(0.5 * 32 * 100 * sin(2 * pi() / 32), 6)", "sq": "(x1 - x0 + 20) * (y1 - y0 + 20)", "v": "2.0"})
functions_on("fn_lines", "z", "n_nationkey",
    {"mid": "st_x(st_lineinterpolatepoint(st_makeline(st_point(x0, y0), st_point(x1, y0)), 0.5))", "loc": "st_linelocatepoint(st_makeline(st_point(x0, y0), st_point(x1, y0)), st_point(x0 + 500, 7))", "sub": "st_length(st_linesubstring(st_makeline(st_point(x0, y0), st_point(x1, y0)), 0.25, 0.75))", "seg": "st_npoints(st_segmentize(st_makeline(st_point(x0, y0), st_point(x1, y0)), 100))", "sx": "st_x(st_startpoint(st_reverse(st_makeline(st_point(x0, y0), st_point(x1, y0)))))", "p2": "st_x(st_pointn(st_exteriorring(geometry), 2))", "simp": "st_npoints(st_simplify(st_geomfromtext('LINESTRING(0 0,1 0.001,2 0,3 0.001,4 0)'), 0.1))", "merged": "st_npoints(st_linemerge(st_geomfromtext('MULTILINESTRING((0 0,1 1),(1 1,2 2))')))", "dumped": "size(st_dump(st_points(geometry)))"},
    {"mid": "(x0 + x1) / 2", "loc": "500 / (x1 - x0)", "sub": "(x1 - x0) / 2", "seg": "21", "sx": "x1", "p2": "x1", "simp": "2", "merged": "3", "dumped": "5"})


# ---- aggregates


@query(f"SELECT c_nationkey, min(x) AS x0, max(y) AS y1, count(*) AS n, avg(1.0) AS np, round((max(x) - min(x)) * (max(y) - min(y)), 3) AS area FROM ({POINTS}) GROUP BY c_nationkey")
def agg_envelope_analyze_collect(spark, d):
    g = points(spark, d).groupBy("c_nationkey").agg(st.st_envelope_agg("geometry").alias("e"), st.st_analyze_agg("geometry").alias("a"), st.st_collect_agg("geometry").alias("c"))
    return g.selectExpr("c_nationkey", "st_xmin(e) AS x0", "st_ymax(e) AS y1", "cast(st_numgeometries(c) as bigint) AS n", "a.mean_points_per_geometry AS np", "round(st_area(e), 3) AS area")


@query(f"SELECT n_nationkey % 5 AS k, round(sum((x1 - x0) * (y1 - y0)), 3) AS u, max(x1) - min(x0) AS w, round((max(x1) - min(x0)) * (max(y1) - min(y0)), 3) AS h FROM ({ZONES}) GROUP BY n_nationkey % 5")
def agg_union_hull(spark, d):
    z = zones(spark, d).withColumn("k", F.col("n_nationkey") % 5)
    g = z.groupBy("k").agg(st.st_union_agg("geometry").alias("u"), st.st_convexhull_agg("geometry").alias("h"))
    return g.selectExpr("k", "round(st_area(u), 3) AS u", "st_xmax(u) - st_xmin(u) AS w", "round(st_area(h), 3) AS h")


@query("SELECT count(*)::INTEGER AS n, power(least(1, 9) - greatest(max(-n_nationkey), 0), 2.0) AS area, power(count(*) FILTER (n_nationkey < 4) - 1, 2)::INTEGER AS faces FROM nation")
def agg_intersection_polygonize(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey AS k")
    boxes = n.selectExpr("st_geomfromtext(concat('POLYGON((', -k, ' ', -k, ',1 ', -k, ',1 1,', -k, ' 1,', -k, ' ', -k, '))')) AS g").unionAll(n.selectExpr("st_geomfromtext('POLYGON((0 0,9 0,9 9,0 9,0 0))') AS g"))
    grid = n.where("k < 4").selectExpr("explode(array(st_geomfromtext(concat('LINESTRING(', k, ' 0,', k, ' 3)')), st_geomfromtext(concat('LINESTRING(0 ', k, ',3 ', k, ')')))) AS g")
    whole = boxes.where("not st_isempty(g) and st_area(g) > 0").agg(F.expr("st_area(st_intersection_agg(g))").alias("area"))
    faces = grid.agg(F.expr("st_unaryunion(st_collect_agg(g))").alias("g")).agg(F.expr("st_numgeometries(st_polygonize_agg(g))").alias("faces"))
    return n.agg(F.count("*").cast("int").alias("n")).crossJoin(whole).crossJoin(faces)


# ---- rasters: pixel (row * 40 + column) % 251 of a 40 x 30 grid from (0, 30) downwards

_PIX = "SELECT r, c, (r * 40 + c) % 251 AS v FROM (SELECT unnest(range(30)) AS r), (SELECT unnest(range(40)) AS c)"
RASTER = "rs_make(transform(sequence(0, 1199), i -> cast(i % 251 as double)), 40, 30, 0, 30, 1, -1, '', 'float64')"


@query("SELECT 40::BIGINT AS w, 30::BIGINT AS h, 1::BIGINT AS nb, 0.0 AS ulx, 30.0 AS uly, 1.0 AS sx, -1.0 AS sy, 0 AS srid, 'REAL_64BITS' AS t, 3857 AS srid2, 1200.0 AS area, 2.0 AS px, 27.0 AS py, 2.5 AS wx, 3 AS cx")
def raster_metadata(spark, d):
    return spark.range(1).selectExpr(f"{RASTER} AS r").selectExpr(
        "rs_width(r) AS w", "rs_height(r) AS h", "rs_numbands(r) AS nb", "rs_upperleftx(r) AS ulx", "rs_upperlefty(r) AS uly", "rs_scalex(r) AS sx", "rs_scaley(r) AS sy", "coalesce(rs_srid(r), 0) AS srid",
        "rs_bandpixeltype(r) AS t", "rs_srid(rs_setsrid(r, 3857)) AS srid2", "st_area(rs_convexhull(r)) AS area", "st_x(rs_pixelaspoint(r, 3, 4)) AS px", "st_y(rs_pixelaspoint(r, 3, 4)) AS py", "st_x(rs_pixelascentroid(r, 3, 4)) AS wx", "rs_worldtorastercoordx(r, 3.7, 20) AS cx",
    )


@query(f"SELECT k.k AS k, v::DOUBLE AS v FROM (SELECT unnest(range(25)) AS k) k JOIN ({_PIX}) p ON p.c = k.k + 3 AND p.r = k.k")
def raster_value(spark, d):
    return table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) AS k", f"rs_value({RASTER}, st_point(n_nationkey + 3.5, 29.5 - n_nationkey)) AS v")


@query(f"SELECT count(*)::BIGINT AS n, sum(v)::DOUBLE AS s, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, round(avg(v), 6) AS m, round(stddev_samp(v), 6) AS sd, median(v)::DOUBLE AS md FROM ({_PIX}) WHERE c >= 5 AND c < 20 AND r >= 10 AND r < 22")
def raster_zonal_stats(spark, d):
    s = spark.range(1).selectExpr(f"rs_zonalstatsall({RASTER}, st_geomfromtext('POLYGON((5 8,20 8,20 20,5 20,5 8))')) AS s")
    return s.selectExpr("s.count AS n", "s.sum AS s", "s.min AS lo", "s.max AS hi", "round(s.mean, 6) AS m", "round(s.stddev, 6) AS sd", "s.median AS md")


@query(f"SELECT (c // 16)::INTEGER AS x, (r // 16)::INTEGER AS y, count(*)::BIGINT AS n, sum(v)::DOUBLE AS s FROM ({_PIX}) GROUP BY 1, 2")
def raster_tiles(spark, d):
    t = spark.range(1).selectExpr(f"explode(rs_tile({RASTER}, 16, 16)) AS t").selectExpr("t.x AS x", "t.y AS y", "rs_zonalstatsall(t.tile, rs_convexhull(t.tile)) AS s")
    return t.selectExpr("x", "y", "s.count AS n", "s.sum AS s")


@query(f"SELECT count(*)::BIGINT AS n, sum(v)::DOUBLE AS s, 15::BIGINT AS w, 12::BIGINT AS h, 20::BIGINT AS w2, 1200::BIGINT AS tiff, 251 AS kinds FROM ({_PIX}) WHERE c >= 5 AND c < 20 AND r >= 10 AND r < 22")
def raster_clip_resample_formats(spark, d):
    r = spark.range(1).selectExpr(f"{RASTER} AS r").selectExpr("r", "rs_clip(r, 1, st_geomfromtext('POLYGON((5 8,20 8,20 20,5 20,5 8))')) AS c", "rs_resample(r, 20, 15, false, 'Average') AS h")
    r = r.selectExpr("*", "rs_zonalstatsall(c, rs_convexhull(c)) AS s", "rs_zonalstatsall(rs_fromgdalraster(rs_asgeotiff(r, 'deflate')), rs_convexhull(r)) AS t", "rs_polygonize(r, 1) AS p")
    return r.selectExpr("s.count AS n", "s.sum AS s", "rs_width(c) AS w", "rs_height(c) AS h", "rs_width(h) AS w2", "t.count AS tiff", "cast(size(array_distinct(transform(p, q -> q.value))) as int) AS kinds")


# ---- sources and sinks


@query(f"SELECT count(*)::BIGINT AS n, round(sum(x), 2) AS sx, 'OGC:CRS84' AS crs FROM ({POINTS}) WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500")
def geoparquet_round_trip(spark, d):
    import uuid

    from .plans.shared import delete_at_exit, shared_dir
    from .sources import geoparquet

    path = f"{shared_dir(spark)}/geoparquet-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    geoparquet.write(points(spark, d).withColumn("geometry", F.expr("st_setsrid(geometry, 4326)")), path, geoparquet_version="1.1", sort_by=["geometry"])
    got = geoparquet.read(spark, path, bbox=(0, 0, 5000, 500))
    return got.agg(F.count("*").alias("n"), F.round(F.sum(st.st_x("geometry")), 2).alias("sx"), F.min(st.st_crs("geometry")).alias("crs"))


@query("SELECT 500::BIGINT AS n, 500::BIGINT AS ids, 0::BIGINT AS bad")
def random_geometry(spark, d):
    from .sources.random_geometry import random_geometry as made

    g = made(spark, geom_type="Polygon", num_rows=500, num_partitions=4, hole_rate=0.5, seed=7)
    return g.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count(F.when(~st.st_isvalid("geometry"), 1)).alias("bad"))


# ---- relational operators

both("rel_pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")  # fmt: skip
both("rel_join_group_having", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10")
both("rel_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
both("rel_full_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50")
both("rel_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000)")
both("rel_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("rel_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INTEGER AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("rel_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("rel_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
both("rel_window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "SELECT o_orderkey, (row_number() OVER w)::INTEGER AS rn, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr, (ntile(4) OVER w)::INTEGER AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
both("rel_window_frames", """SELECT o_orderkey, lag(o_totalprice) OVER w AS lg, lead(o_totalprice, 2) OVER w AS ld, first_value(o_orderkey) OVER w AS fv, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")  # fmt: skip
both("rel_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("rel_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("rel_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("rel_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("rel_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
both("rel_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
both("rel_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
both("rel_scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
both("rel_cte_correlated", "WITH t AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT o_orderkey FROM t JOIN orders USING (o_custkey) WHERE o_totalprice = m")
both("rel_strings", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 4) AS s, length(c_name) AS n, replace(c_name, 'Customer', 'C') AS r, lpad(c_mktsegment, 12, '*') AS p, trim(concat(' ', c_name, ' ')) AS t, reverse(c_name) AS v FROM customer",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 4) AS s, length(c_name)::INTEGER AS n, replace(c_name, 'Customer', 'C') AS r, lpad(c_mktsegment, 12, '*') AS p, trim(concat(' ', c_name, ' ')) AS t, reverse(c_name) AS v FROM customer")
both("rel_regex", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r FROM part", None)
ORACLES["rel_regex"] = "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r FROM part"
QUERIES["rel_regex"] = lambda spark, d: table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "[aeiou]", "_").alias("r"))
both("rel_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(o_orderdate AS DATE) AS d FROM orders",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(o_orderdate AS DATE) AS d FROM orders")
both("rel_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS s, round(power(c_acctbal / 1000, 2), 6) AS p, greatest(c_acctbal, 0) AS g, coalesce(nullif(c_nationkey, 0), -1) AS n, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS sign FROM customer")
both("rel_arrays", "SELECT n_nationkey, size(sequence(0, n_nationkey)) AS n, element_at(sequence(0, n_nationkey), 1) AS f, array_contains(array(1, 2, 3), n_nationkey) AS c FROM nation",
    "SELECT n_nationkey, len(range(0, n_nationkey + 1))::INTEGER AS n, range(0, n_nationkey + 1)[1]::INTEGER AS f, list_contains([1, 2, 3], n_nationkey) AS c FROM nation")
both("rel_unnest", "SELECT n_nationkey, explode(sequence(0, n_nationkey % 4)) AS v FROM nation", "SELECT n_nationkey, unnest(range(0, n_nationkey % 4 + 1))::INTEGER AS v FROM nation")
both("rel_maps_structs", "SELECT n_nationkey, map('x', n_nationkey, 'y', 2)['x'] AS m, named_struct('a', n_name, 'b', 1).a AS s FROM nation", "SELECT n_nationkey, n_nationkey AS m, n_name AS s FROM nation")
both("rel_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
both("rel_hashes", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
both("rel_statistics", "SELECT c_nationkey, round(stddev(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS v, round(median(c_acctbal), 4) AS md, count(DISTINCT c_mktsegment) AS k, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey")
both("rel_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("rel_time_windows", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")


@query("SELECT DISTINCT c_nationkey FROM customer")
def frame_distinct_on(spark, d):
    from .session import connect

    return connect(spark).frame(table(spark, d, "customer")).distinct_on("c_nationkey").select("c_nationkey").df


@query("SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 100 AND c_nationkey IN (1, 2, 3)")
def frame_select_mutate_filter(spark, d):
    from .session import connect

    f = connect(spark).frame(table(spark, d, "customer"))
    return f.filter(f.c_acctbal > 100, f.c_nationkey.isin(1, 2, 3)).mutate(twice=f.c_acctbal * 2).select("c_custkey", "c_name", "twice").df


@query("SELECT a.vec_id AS q, b.vec_id AS v FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) <= 5")
def embedding_knn(spark, d):
    """The stated query set of searches: every row whose id is divisible by 50, against all rows."""
    from .operators.vector_knn import vector_knn

    e = table(spark, d, "embeddings")
    return vector_knn(e.where("vec_id % 50 = 0"), e, 5)


from . import function_queries as _function_queries  # noqa: E402, F401  its queries register themselves
