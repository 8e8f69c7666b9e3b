"""Joins against brute force over random shapes, with nulls and empties."""

import pytest

from geoflux import functions as st
from geoflux.operators import distance_join, knn_join, spatial_join
from geoflux.sources.random_geometry import random_geometry


@pytest.fixture(scope="module")
def sides(spark):
    st.register(spark)
    a = random_geometry(spark, geom_type="Point", num_rows=300, num_partitions=3, null_rate=0.05, empty_rate=0.05, seed=42).selectExpr("id AS a", "geometry AS ga").cache()
    b = random_geometry(spark, geom_type="Polygon", num_rows=120, num_partitions=2, num_vertices=[3, 8], hole_rate=0.5, null_rate=0.05, empty_rate=0.05, size=[1, 30], seed=43).selectExpr("id AS b", "geometry AS gb").cache()
    return a, b


def pairs(df):
    return sorted((r.a, r.b) for r in df.select("a", "b").collect())


def brute(df):
    """The pairs without the planner's keys: all rows are held against all."""
    conf = df.sparkSession.conf
    conf.set("geoflux.join.keys", "false")
    try:
        assert "NestedLoop" in df._jdf.queryExecution().optimizedPlan().toString() or "geoflux_key" not in df._jdf.queryExecution().optimizedPlan().toString()
        return pairs(df)
    finally:
        conf.unset("geoflux.join.keys")


@pytest.mark.parametrize("limit", [0, 1 << 25])
@pytest.mark.parametrize("predicate", ["intersects", "within", "coveredby"])
def test_relation_join(sides, predicate, limit):
    a, b = sides
    want = pairs(a.crossJoin(b).where(f"st_{predicate}(ga, gb)"))
    assert want and pairs(spatial_join(a, b, predicate, "ga", "gb", broadcast_bytes=limit)) == want


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_polygon_overlaps(sides, limit):
    _, b = sides
    c = b.selectExpr("b AS a", "gb AS ga")
    assert pairs(spatial_join(c, b, "intersects", "ga", "gb", broadcast_bytes=limit)) == pairs(c.crossJoin(b).where("st_intersects(ga, gb)"))


@pytest.mark.parametrize("how", ["left", "right", "full", "left_semi", "left_anti", "right_semi", "right_anti", "left_mark"])
def test_kinds_of_join(sides, how):
    a, b = sides
    got = spatial_join(a, b, "within", "ga", "gb", how=how, broadcast_bytes=0)
    hit = pairs(a.crossJoin(b).where("st_within(ga, gb)"))
    la, rb = {x for x, _ in hit}, {y for _, y in hit}
    ids_a, ids_b = {r.a for r in a.collect()}, {r.b for r in b.collect()}
    none = {"left": [(x, None) for x in ids_a - la], "right": [(None, y) for y in ids_b - rb]}
    key = lambda p: tuple((v is None, v or 0) for v in p)
    if how in ("left", "right", "full"):
        want = hit + (none["left"] if how != "right" else []) + (none["right"] if how != "left" else [])
        assert sorted(((r.a, r.b) for r in got.collect()), key=key) == sorted(want, key=key)
    elif how == "left_mark":
        assert {(r.a, r.mark) for r in got.collect()} == {(x, x in la) for x in ids_a}
    else:
        want = {"left_semi": la, "left_anti": ids_a - la, "right_semi": rb, "right_anti": ids_b - rb}[how]
        assert sorted(r[0] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_distance_join(sides, limit):
    a, b = sides
    assert pairs(distance_join(a, b, 5.0, "ga", "gb", broadcast_bytes=limit)) == pairs(a.crossJoin(b).where("st_dwithin(ga, gb, 5.0)"))
    c = a.selectExpr("*", "a % 7.0 AS r")
    assert pairs(distance_join(c, b, "r", "ga", "gb", broadcast_bytes=limit)) == pairs(c.crossJoin(b).where("st_dwithin(ga, gb, r)"))


@pytest.mark.parametrize("k", [1, 3, 200])
def test_knn_join(sides, k):
    a, b = sides
    want = a.crossJoin(b).withColumn("d", st.st_distance("ga", "gb")).where("d is not null").selectExpr("a", "b", "d", "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r").where(f"r <= {k}")
    assert pairs(knn_join(a, b, k, "ga", "gb", tie_break="b")) == pairs(want)


def test_knn_join_in_cells(spark, monkeypatch):
    from geoflux.operators import knn

    st.register(spark)
    q = spark.range(150).selectExpr("id AS a", "st_point((id * 7919) % 1000, (id * 104729) % 997) AS ga")
    o = spark.range(2500).selectExpr("id AS b", "st_point((id * 31) % 500, (id * id) % 991) AS gb")
    monkeypatch.setattr(knn, "SAMPLE", 40)
    want = q.crossJoin(o).withColumn("d", st.st_distance("ga", "gb")).selectExpr("a", "b", "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r").where("r <= 4")
    assert pairs(knn_join(q, o, 4, "ga", "gb", tie_break="b")) == pairs(want)


def rows_by_operator(df):
    """The largest number of rows that a part of the executed plan gave."""
    df.collect()

    def most(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return most(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return most(p.plan())
        m = p.metrics().get("numOutputRows")
        children = [p.children().apply(i) for i in range(p.children().size())]
        return max([m.get().value() if m.isDefined() else 0, *map(most, children)])

    return most(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("way", ["frame", "sql"])
def test_knn_gives_few_rows_where_many_objects_lie_in_reach(spark, monkeypatch, way):
    from geoflux.operators import knn
    from geoflux.session import connect

    st.register(spark)
    # Of a sample of few, the radius of a query holds most of the objects.
    q = spark.range(400).selectExpr("id AS a", "st_point((id * 7919) % 100 / 100, (id * 104729) % 97 / 100) AS ga").cache()
    o = spark.range(20000).selectExpr("id AS b", "st_point((id * 31) % 499 / 499, (id * id) % 991 / 991) AS gb").cache()
    monkeypatch.setattr(knn, "SAMPLE", 4)
    want = q.crossJoin(o).withColumn("d", st.st_distance("ga", "gb")).selectExpr("a", "b", "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r").where("r <= 3")
    if way == "frame":
        df = knn_join(q, o, 3, "ga", "gb", tie_break="b").select("a", "b")
        assert rows_by_operator(df) < 400_000
    else:  # equally far objects go by their first column; the radius comes from 16,384 objects
        q.createOrReplaceTempView("a")
        o.createOrReplaceTempView("b")
        df = connect(spark).sql("SELECT a, b FROM a JOIN b ON ST_KNN(ga, gb, 3)").df
        assert pairs(spark.sql("SELECT a, b FROM a JOIN b ON ST_KNN(ga, gb, 3)")) == pairs(want)
    assert pairs(df) == pairs(want)


@pytest.mark.parametrize("k", [1, 7, 3000])
def test_knn_of_equal_places(spark, k):
    """Thousands of objects in one place fill several blocks; all of them tie."""
    st.register(spark)
    q = spark.range(12).selectExpr("id AS a", "st_point(id % 4, 0) AS ga")
    o = spark.range(4000).selectExpr("id AS b", "st_point(if(id < 3500, 1, id % 50), 0) AS gb")
    near = q.crossJoin(o).withColumn("d", st.st_distance("ga", "gb"))
    assert pairs(knn_join(q, o, k, "ga", "gb", tie_break="b")) == pairs(near.selectExpr("a", "b", "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r").where(f"r <= {k}"))
    assert pairs(knn_join(q, o, k, "ga", "gb", ties=True)) == pairs(near.selectExpr("a", "b", "rank() OVER (PARTITION BY a ORDER BY d) AS r").where(f"r <= {k}"))
    # The objects are the larger side here: they have one key, and the queries several.
    few = q.where("a < 2")
    assert pairs(knn_join(few, o, k, "ga", "gb", tie_break="b")) == pairs(near.where("a < 2").selectExpr("a", "b", "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r").where(f"r <= {k}"))


def test_knn_on_the_sphere(spark):
    st.register(spark)
    q = spark.range(60).selectExpr("id AS a", "st_point((id * 7919) % 360 - 180, (id * 104729) % 170 - 85) AS ga")
    o = spark.range(900).selectExpr("id AS b", "st_point((id * 31) % 360 - 180, (id * id) % 171 - 85) AS gb")
    want = q.crossJoin(o).selectExpr("a", "b", "st_distance(st_togeography(ga), st_togeography(gb)) AS d").selectExpr("a", "b", "row_number() OVER (PARTITION BY a ORDER BY d, b) AS r").where("r <= 3")
    assert pairs(knn_join(q, o, 3, "ga", "gb", use_spheroid=True, tie_break="b")) == pairs(want)


def test_empty_sides(sides):
    a, b = sides
    assert spatial_join(a.limit(0), b, "within", "ga", "gb", broadcast_bytes=0).count() == 0
    assert knn_join(a, b.limit(0), 2, "ga", "gb").count() == 0
    with pytest.raises(ValueError):
        spatial_join(a, b, "disjoint", "ga", "gb")


def test_embedding_knn_asks_for_every_fiftieth_row(spark, monkeypatch):
    import duckdb

    from geoflux import queries
    from geoflux.operators import vector_knn

    monkeypatch.setattr(vector_knn, "QUERIES", 7)
    monkeypatch.setattr(vector_knn, "CANDIDATES", 300)
    d = "/root/testdata/sf0.1"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(db.execute(queries.ORACLES["embedding_knn"]).fetchall())
    got = sorted((r.q, r.v) for r in queries.QUERIES["embedding_knn"](spark, d).collect())
    assert got == want and {q for q, _ in got} == {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").collect()}


def test_vector_knn_ties_and_nulls(spark):
    from geoflux.operators.vector_knn import vector_knn

    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.q, r.v) for r in vector_knn(v.where("vec_id in (2, 3)"), v, 3).collect())
    assert got == [(2, 1), (2, 2), (2, 4), (3, 1), (3, 2), (3, 3)]
    assert vector_knn(v.limit(0), v, 3).count() == 0 and vector_knn(v, v.limit(0), 3).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(df):
    return "geoflux_key" in plan(df) and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


@pytest.mark.parametrize("predicate", ["intersects", "contains", "within", "covers", "coveredby", "touches", "crosses", "overlaps", "equals"])
def test_sql_relation_join(spark, sides, predicate):
    _, b = sides
    b.createOrReplaceTempView("b")
    b.selectExpr("b AS a", "st_translate(gb, if(b % 3 = 0, 0, 2), 1) AS ga").union(b.selectExpr("b + 1000 AS a", "gb AS ga")).createOrReplaceTempView("a")
    text = f"SELECT a, b FROM a JOIN b ON st_{predicate}(ga, gb)"
    assert keyed(spark.sql(text)) and pairs(spark.sql(text)) == brute(spark.sql(text))


@pytest.mark.parametrize("text", [
    "SELECT a, b FROM a LEFT JOIN b ON st_within(ga, gb) AND a > 20", "SELECT a, b FROM a RIGHT JOIN b ON st_within(ga, gb) AND b > 20", "SELECT a, 0 AS b FROM a WHERE EXISTS (SELECT 1 FROM b WHERE st_contains(gb, ga))",
    "SELECT a, 0 AS b FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE st_contains(gb, ga))", "SELECT a, EXISTS (SELECT 1 FROM b WHERE st_contains(gb, ga)) AS b FROM a", "SELECT a, b FROM a JOIN b ON st_dwithin(ga, gb, 5)",
    "SELECT a, b FROM a JOIN b ON st_dwithin(gb, ga, a % 7)", "SELECT a, b FROM a, b WHERE st_distance(ga, gb) < b % 5", "SELECT a, b FROM a, b WHERE 4 >= st_distance(ga, gb) AND a <> b", "SELECT a, b FROM a LEFT JOIN b ON st_dwithin(ga, gb, -1)",
])
def test_sql_kinds_of_join(spark, sides, text):
    for df, name in zip(sides, "ab", strict=True):
        df.createOrReplaceTempView(name)
    rows = lambda: sorted(((r.a, r.b) for r in spark.sql(text).collect()), key=str)
    got = rows()
    assert got and keyed(spark.sql(text)) or "-1" in text
    spark.conf.set("geoflux.join.keys", "false")
    try:
        assert got == rows()
    finally:
        spark.conf.unset("geoflux.join.keys")


@pytest.mark.parametrize("how", ["ST_Intersects(ga, gb)", "ST_DWithin(ga, gb, 700000)", "ST_Distance(gb, ga) <= 2e6"])
def test_sql_join_on_the_sphere(spark, how):
    st.register(spark)
    spark.range(300).selectExpr("id AS a", "st_geogpoint((id * 7919) % 360 - 180, (id * 104729) % 179 - 89) AS ga").createOrReplaceTempView("a")
    spark.range(150).selectExpr("id AS b", "(id * 131) % 360 - 180D AS x", "(id * id) % 171 - 85D AS y").selectExpr(
        "b", "st_togeography(st_geomfromtext(concat('LINESTRING(', x, ' ', y, ',', if(x > 160, x - 340, x + 20), ' ', y + 3, ')'))) AS gl", "st_geogpoint(x, y) AS gp", "st_geogpoint((b * 7919) % 360 - 180, (b * 104729) % 179 - 89) AS same",
    ).selectExpr("b", "explode(array(gl, gp, same)) AS gb").createOrReplaceTempView("b")
    df = spark.sql(f"SELECT a, b FROM a JOIN b ON {how}")
    assert keyed(df) and pairs(df) == brute(spark.sql(f"SELECT a, b FROM a JOIN b ON {how}")) != []


def test_sql_knn_join(spark, sides):
    from geoflux.session import connect

    ctx = connect(spark)
    for df, name in zip(sides, "ab", strict=True):
        df.createOrReplaceTempView(name)
    near = sides[0].crossJoin(sides[1]).selectExpr("a", "b", "st_distance(ga, gb) AS d").where("d is not null").selectExpr("a", "b", "d", "rank() OVER (PARTITION BY a ORDER BY d) AS r").collect()
    for k, rest in ((1, ""), (5, ""), (500, ""), (5, " AND b % 2 = 0 AND a < 100")):
        df = ctx.sql(f"SELECT a, b, st_distance(ga, gb) AS d FROM a JOIN b ON ST_KNN(ga, gb, {k}, false){rest}").df
        assert keyed(df)
        # Which of equally far objects is taken is open, so distances are compared.
        want = sorted((x.a, x.d) for x in near if x.r <= k)
        got = sorted((x.a, x.d) for x in df.collect())
        if not rest:
            counts = {a: sum(x.a == a for x in near) for a in {x.a for x in near}}
            want = sorted(y for a in counts for y in sorted((x.a, x.d) for x in near if x.a == a)[:k])
            assert got == want
        else:
            assert set(got) <= set(want) and {(x.a, x.b) for x in df.collect()} <= {(x.a, x.b) for x in near if x.r <= k and x.b % 2 == 0 and x.a < 100}
    assert ctx.sql("SELECT a, b FROM a, b WHERE ST_KNN(ga, gb, 0)").df.count() == 0


def test_sql_join_of_sides_that_change_between_looks(spark):
    st.register(spark)
    a = spark.range(4000).selectExpr("id AS a", "st_buffer(st_point(id % 63, id % 61), pow(2, id % 14) / 200, 'quad_segs=1') AS ga")
    b = spark.range(200).selectExpr("id AS b", "st_point(id % 59, id % 53) AS gb")
    for left in (a.orderBy("a").limit(3000), a.where("rand(3) < 2"), a.sample(1.0, seed=5), a.dropDuplicates(["a"])):
        left.createOrReplaceTempView("a")
        b.createOrReplaceTempView("b")
        df = spark.sql("SELECT a, b FROM a LEFT JOIN b ON st_intersects(ga, gb)")
        assert keyed(df)
        got = sorted((r.a, -1 if r.b is None else r.b) for r in df.collect())
        spark.conf.set("geoflux.join.keys", "false")
        try:
            want = sorted((r.a, -1 if r.b is None else r.b) for r in spark.sql("SELECT a, b FROM a LEFT JOIN b ON st_intersects(ga, gb)").collect())
        finally:
            spark.conf.unset("geoflux.join.keys")
        assert got == want and len(got) > 4000


def test_sql_join_of_a_stream(spark, tmp_path):
    st.register(spark)
    spark.range(50).selectExpr("id").write.parquet(str(tmp_path / "in"))
    spark.range(10).selectExpr("id AS b", "st_buffer(st_point(id * 5, 0), 1.5) AS gb").createOrReplaceTempView("b")
    spark.readStream.schema("id long").parquet(str(tmp_path / "in")).selectExpr("id AS a", "st_point(id, 0) AS ga").createOrReplaceTempView("s")
    q = spark.sql("SELECT a, b FROM s JOIN b ON st_intersects(ga, gb)").writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("hits").collect()) == sorted((a, b) for a in range(50) for b in range(10) if abs(a - 5 * b) <= 1)
