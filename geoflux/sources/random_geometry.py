"""The table function ``sd_random_geometry('{"geom_type": "Polygon", ...}')``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DEFAULTS = {
    "geom_type": "Point", "num_rows": 1024, "num_partitions": 1, "rows_per_batch": 1024, "num_vertices": 4, "num_parts": 1, "size": [1.0, 10.0],
    "bounds": [0.0, 0.0, 100.0, 100.0], "hole_rate": 0.0, "empty_rate": 0.0, "null_rate": 0.0, "seed": 42,
}
SCHEMA = "id int, dist double, geometry binary"


def rows(options: dict):
    """Random rows: shapes are regular polygons on circles inside the bounds, from one seed."""
    import math
    import random
    import struct

    o = {**DEFAULTS, **options}
    unknown = o.keys() - DEFAULTS.keys()
    if unknown:
        raise ValueError(f"not options of random geometries: {sorted(unknown)}")
    r = random.Random(o["seed"])
    x0, y0, x1, y1 = o["bounds"]
    pair = lambda v: (v, v) if isinstance(v, (int, float)) else tuple(v)
    size, vertices, parts = pair(o["size"]), pair(o["num_vertices"]), pair(o["num_parts"])
    head = lambda k: struct.pack("<BI", 1, k)
    ring = lambda c: struct.pack("<I", len(c)) + b"".join(struct.pack("<dd", *p) for p in c)
    # Fixed codes of WKB.
    codes = {"point": 1, "linestring": 2, "polygon": 3, "multipoint": 4, "multilinestring": 5, "multipolygon": 6, "geometrycollection": 7, "geometry": 0}
    kind = codes[o["geom_type"].lower()]

    def shape(k: int) -> bytes:
        if r.random() < o["empty_rate"]:
            return head(k) + (struct.pack("<dd", math.nan, math.nan) if k == 1 else struct.pack("<I", 0))
        if k > 3:
            n = r.randint(int(parts[0]), int(parts[1]))
            return head(k) + struct.pack("<I", n) + b"".join(shape(k - 3 if k < 7 else r.randint(1, 3)) for _ in range(n))
        if k == 1:
            return head(1) + struct.pack("<dd", r.uniform(x0, x1), r.uniform(y0, y1))
        half = min(r.uniform(*size), x1 - x0, y1 - y0) / 2
        cx, cy, turn = r.uniform(x0 + half, x1 - half), r.uniform(y0 + half, y1 - half), r.uniform(0, 2 * math.pi)
        n = r.randint(int(vertices[0]), int(vertices[1]))
        circle = lambda f, m: [(cx + f * half * math.cos(turn + 2 * math.pi * i / m), cy + f * half * math.sin(turn + 2 * math.pi * i / m)) for i in range(m)]
        if k == 2:
            return head(2) + ring(circle(1, max(2, n)))
        out = circle(1, max(3, n))
        rings = [out + out[:1]]
        if r.random() < o["hole_rate"]:
            hole = circle(0.5, max(3, n))[::-1]
            rings.append(hole + hole[:1])
        return head(3) + struct.pack("<I", len(rings)) + b"".join(map(ring, rings))

    for i in range(o["num_rows"]):
        none = r.random() < o["null_rate"]
        g = shape(kind or r.randint(1, 7))
        yield i, r.uniform(0, 100), None if none else g


def random_geometry(spark: SparkSession, **options) -> DataFrame:
    """As many partitions as asked for, each with its share of the rows and a seed of its own."""
    from ..ship import ship

    ship(spark)
    o = {**DEFAULTS, **options}
    n, p = o["num_rows"], max(1, o["num_partitions"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = n * k // p, n * (k + 1) // p
                got = list(rows({**options, "num_rows": hi - lo, "seed": o["seed"] * 1_000_003 + k}))
                for a in range(0, len(got), o["rows_per_batch"]):
                    part = got[a : a + o["rows_per_batch"]]
                    yield pa.RecordBatch.from_arrays([pa.array([lo + g[0] for g in part], pa.int32()), pa.array([g[1] for g in part]), pa.array([g[2] for g in part], pa.binary())], names=["id", "dist", "geometry"])

    return spark.range(0, p, 1, p).mapInArrow(run, SCHEMA)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    class RandomGeometry:
        def eval(self, options: str = "{}"):
            import json

            from geoflux.sources.random_geometry import rows as made

            for row in made(json.loads(options) if options else {}):
                yield row

    spark.udtf.register("sd_random_geometry", udtf(RandomGeometry, returnType=SCHEMA))


__all__ = ["random_geometry", "register", "rows"]
