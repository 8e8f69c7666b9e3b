"""GeoJSON: newline-delimited features or whole feature collections, read and written by Spark's JSON machinery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import call, register


def read(spark: SparkSession, paths: str | list[str], multiline: bool = True, schema: str | None = None, properties: str | None = None) -> DataFrame:
    """``properties`` columns and ``geometry``. ``multiline`` files hold a FeatureCollection each; else a feature a line.

    Coordinates go to WKB by way of text, in SQL: nesting is kept as JSON. ``properties`` is a DDL schema; without it
    one pass infers it.
    """
    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if multiline:
        raw = spark.read.text(paths, wholetext=True)
        features = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    else:
        features = spark.read.text(paths).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("f"))
    ddl = properties
    if ddl is None:
        # A type for each name of a property that all its values allow; nested values stay JSON.
        each = features.select(F.explode(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>")).alias("k", "v"))
        fits = lambda pattern: F.bool_and(F.col("v").rlike(pattern))
        kinds = each.groupBy("k").agg(fits(r"^-?\d{1,18}$").alias("i"), fits(r"^-?[\d.]+([eE][-+]?\d+)?$").alias("d"), fits("^(true|false)$").alias("b")).orderBy("k").collect()
        ddl = ", ".join(f"`{r.k}` {'bigint' if r.i else 'double' if r.d else 'boolean' if r.b else 'string'}" for r in kinds)
    p = F.from_json(F.get_json_object("f", "$.properties"), ddl if ddl.startswith("struct") else f"struct<{ddl}>")
    return features.select(p.alias("p"), call("geoflux_fromgeojson", F.get_json_object("f", "$.geometry")).alias("geometry")).select("p.*", "geometry")


def write(df: DataFrame, path: str, geometry: str = "geometry", mode: str = "errorifexists") -> None:
    """A feature a line, in as many files as partitions."""
    register(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != geometry]
    props = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(call("st_asgeojson", F.col(f"`{geometry}`")), F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.mode(mode).text(path)
