"""The lazy frame's verbs, UDFs, streaming and the registered queries."""

import pytest
from pyspark.sql import functions as F

from geoflux.functions.udf import arrow_aggregate_udf, arrow_udf, geo
from geoflux.session import connect


@pytest.fixture(scope="module")
def ctx(spark):
    return connect(spark)


@pytest.fixture(scope="module")
def t(ctx):
    return ctx.create_data_frame([(1, "a", 10.0), (2, "b", None), (3, "a", 30.0)], "k int, s string, v double")


def rows(f):
    return [tuple(r) for r in f.collect()]


def test_verbs(t):
    assert rows(t.select("k", twice=t.v * 2).sort("k")) == [(1, 20.0), (2, None), (3, 60.0)]
    assert t.mutate(v=t.k, w=t.v).columns == ["k", "s", "v", "w"]
    assert rows(t.mutate(v=t.k, w=t.v).sort("k"))[0] == (1, "a", 1, 10.0)
    assert t.rename(key="k").columns == ["key", "s", "v"] and t.drop("s").columns == ["k", "v"]
    assert rows(t.sort("v").select("k")) == [(1,), (3,), (2,)] and rows(t.sort(t.v.desc_nulls_last()).select("k")) == [(3,), (1,), (2,)]
    assert rows(t.sort("k").limit(1, offset=1).select("k")) == [(2,)]
    assert sorted(rows(t.group_by("s").agg(n=F.count("*"), m=F.sum("v")))) == [("a", 2, 40.0), ("b", 1, None)]
    assert rows(t.agg(n=F.count("v"))) == [(2,)] and t.distinct_on("s").count() == 2


def test_strictness(t):
    for wrong, error in ((lambda: t.select(), ValueError), (lambda: t.drop("x"), KeyError), (lambda: t.rename(a="x"), KeyError), (lambda: t[True], TypeError), (lambda: t[["k"]], TypeError), (lambda: t.filter(True), TypeError),
                         (lambda: t.union(t.drop("s")), ValueError), (lambda: t.join(t, "k", "sideways"), ValueError), (lambda: t.join(t, ["k", t.v > 1]), TypeError), (lambda: t.agg(), ValueError)):
        with pytest.raises(error):
            wrong()


def test_joins_and_sets(ctx, t):
    u = ctx.create_data_frame([(2, "x"), (4, "y")], "k int, z string")
    assert sorted(rows(t.join(u, "k", "outer").select("k"))) == [(1,), (2,), (3,), (4,)]
    assert rows(t.join(u, "k", "right_anti")) == [(4, "y")] and rows(t.join(u, "k", "semi").select("k")) == [(2,)]
    assert t.cross_join(u).count() == 6
    d = t.union(t)
    assert d.count() == 6 and d.union_distinct(t).count() == 3 and d.intersect(d).count() == 6 and d.intersect_distinct(t).count() == 3 and d.except_distinct(t).count() == 0


def test_unnest_params_views(ctx):
    f = ctx.create_data_frame([("a", [1, 2], ["x"])], "l string, p array<int>, q array<string>").unnest("p", "q")
    assert rows(f) == [("a", 1, "x"), ("a", 2, None)]
    assert rows(ctx.sql("SELECT $1 + $2 AS v", [1, 2])) == [(3,)] and rows(ctx.sql("SELECT $x AS v", {"x": 5})) == [(5,)]
    f.to_view("unnested", overwrite=True)
    assert ctx.view("unnested").count() == 2 and ctx.drop_view("unnested")


def test_udfs(ctx, spark):
    @arrow_udf("double")
    def doubled(a):
        import pyarrow.compute as pc

        return pc.multiply(a, 2.0)

    ctx.register(doubled)
    assert rows(ctx.sql("SELECT doubled(CAST(4 AS DOUBLE)) AS v")) == [(8.0,)]

    @arrow_aggregate_udf("double")
    class Total:
        def __init__(self):
            self.v = 0.0

        def update(self, a):
            self.v += sum(x for x in a.to_pylist() if x is not None)

        def state(self):
            return repr(self.v).encode()

        def merge(self, s):
            self.v += float(s)

        def evaluate(self):
            return self.v

    df = spark.range(100).selectExpr("id % 3 AS k", "cast(id AS double) AS v").repartition(4)
    assert sorted(tuple(r) for r in Total.over(df, ["k"], ["v"]).collect()) == [(k, float(sum(range(k, 100, 3)))) for k in range(3)]
    assert [tuple(r) for r in Total.over(df, [], ["v"]).collect()] == [(4950.0,)]
    assert ctx.sql("SELECT st_point(1, 2) AS g").df.select(geo("g").x().alias("x")).head().x == 1.0


def test_stream_join(ctx, spark, tmp_path):
    from geoflux.streaming import join_static

    spark.range(50).selectExpr("id", "cast(id AS double) AS x").write.parquet(str(tmp_path / "in"))
    zones = spark.sql("SELECT z, st_geomfromtext(concat('POLYGON((', z*10, ' 0,', z*10+10, ' 0,', z*10+10, ' 1,', z*10, ' 1,', z*10, ' 0))')) AS geometry FROM (SELECT id AS z FROM range(5))")
    stream = spark.readStream.schema("id long, x double").parquet(str(tmp_path / "in")).selectExpr("id", "st_point(x + 0.5, 0.5) AS geometry")
    q = join_static(stream, zones, "within").select("id", "z").writeStream.format("memory").queryName("joined").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.z) for r in spark.table("joined").collect()) == [(i, i // 10) for i in range(50)]


def test_queries_have_sql_and_run(spark):
    from geoflux import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert queries.QUERIES["point_in_zone_count"](spark, "/root/testdata/sf0.001").count() > 0


def test_geoframe(ctx):
    from geoflux.geoframe import GeoFrame

    g = GeoFrame(ctx.sql("SELECT id, id % 2 AS k, st_geomfromtext(concat('POLYGON((', id, ' 0,', id + 1, ' 0,', id + 1, ' 1,', id, ' 1,', id, ' 0))')) AS geometry FROM range(4)"))
    assert [r.a for r in g.mutate(a=g.geometry.area).sort("id").collect()] == [1.0] * 4
    assert g.dissolve("k").mutate(n=F.expr("st_area(geometry)")).sort("k").select("n").collect() == [(2.0,), (2.0,)]
    assert g.sjoin(g).count() == 10
    assert g.set_geometry(g.geometry.set_crs(4326)).to_crs("EPSG:3857").select(F.expr("st_srid(geometry)").alias("s")).head(1).collect() == [(3857,)]
    assert g.mutate(d=g.geometry.distance(g.geometry.centroid)).agg(m=F.max("d")).collect() == [(0.0,)]


def test_positional_mutate_params_and_reader(spark):
    from pyspark.sql import functions as F

    from geoflux.session import connect

    ctx = connect(spark)
    f = ctx.frame(spark.range(10).selectExpr("id", "id * 2 AS b"))
    assert f.mutate((f.id + 1).alias("c"), (f.b * 2).alias("b"), d=F.lit(1)).columns == ["id", "b", "c", "d"]
    assert [tuple(r) for r in f.mutate((f.b + 1).alias("b")).limit(1).df.collect()] == [(0, 1)]
    assert ctx.sql("SELECT $1 + 1 AS v, '$2' AS t").with_params(4).df.head() == (5, "$2")
    assert ctx.sql("SELECT st_x(st_point($x, 2)) AS v").with_params(x=7.0).df.head().v == 7.0
    reader = f.to_arrow_reader()
    assert reader.schema.names == ["id", "b"] and sorted(reader.read_all()["b"].to_pylist()) == list(range(0, 20, 2))
    assert ctx.frame(spark.range(0)).to_arrow_reader().read_all().num_rows == 0
