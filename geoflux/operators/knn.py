"""k nearest neighbours of each query row, exactly, without comparing all with all.

A bounded sample of the objects gives each query a radius within which k
objects lie for certain: the distance of the k-th nearest of the sample. The planner
gives both sides keys of cells by which a query finds all that lies within it.
The objects of a cell are packed into blocks of bounded size, and a query takes
its k nearest of each block that it meets; these are ranked. So rows grow with
the queries, not with the objects within their radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import jvm
from ..functions import call, register

#: Objects from which the radius is taken.
SAMPLE = 16_384


def _column(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def knn_join(query: DataFrame, objects: DataFrame, k: int = 1, query_geom: str | Column = "geometry", object_geom: str | Column = "geometry",
             ties: bool = False, use_spheroid: bool = False, tie_break: str | None = None, suffix: str = "_right", distance_col: str = "distance") -> DataFrame:
    """Each query row with its ``k`` nearest object rows and their distance.

    Fewer objects than ``k``: all of them. ``ties`` includes objects as far as
    the k-th; otherwise ``tie_break``, a column of the objects, orders equal
    distances. Null and empty geometries take no part. With ``use_spheroid``
    coordinates are longitudes and latitudes and distances are great-circle
    metres.
    """
    register(query.sparkSession)
    conv = (lambda c: call("st_togeography", c)) if use_spheroid else (lambda c: c)
    q = query.select(F.struct(*[F.col(f"`{c}`") for c in query.columns]).alias("q_row"), conv(_column(query_geom)).alias("q_geom"))
    o = objects.select(F.struct(*[F.col(f"`{c}`") for c in objects.columns]).alias("o_row"), conv(_column(object_geom)).alias("o_geom"))
    spark = query.sparkSession
    best = DataFrame(jvm.static(spark, "geoflux.Plan", "neighbours", [spark._jsparkSession, q._jdf, o._jdf, k, ties, tie_break, max(SAMPLE, 4 * k)]), spark)
    names = {c.lower() for c in query.columns}
    return best.select(
        *[F.col(f"q_row.`{c}`").alias(c) for c in query.columns],
        *[F.col(f"o_row.`{c}`").alias(c if c.lower() not in names else c + suffix) for c in objects.columns],
        F.col("d").alias(distance_col),
    )
