"""A hierarchy of grids for joins by place.

Level k has square cells with sides of 2**k. A box belongs to the first level
whose cells are as large as it, and touches four cells of that level at most,
whatever its size; so boxes of all sizes join without long lists of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import call

#: A side is broadcast below this many bytes by the optimizer's own estimate.
BROADCAST_BYTES = 32 * 1024 * 1024
LOWEST = -40


def bounds(geom: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>; null for empty geometries."""
    return call("geoflux_bounds", geom)


def point_bounds(x: Column, y: Column) -> Column:
    """Bounds of a point from two numbers, without a geometry: stays inside generated code."""
    return F.struct(x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), x.cast("double").alias("xmax"), y.cast("double").alias("ymax"))


def own_level(box: str) -> Column:
    """The first level whose cells are as large as the box."""
    side = F.greatest(F.col(f"{box}.xmax") - F.col(f"{box}.xmin"), F.col(f"{box}.ymax") - F.col(f"{box}.ymin"))
    return F.when(side > 0, F.greatest(F.lit(LOWEST), F.ceil(F.log2(side)).cast("int"))).otherwise(F.lit(LOWEST))


def levels_of(df: DataFrame, box: str) -> list[int]:
    """The levels that occur: some dozens at most."""
    return sorted(r[0] for r in df.where(F.col(box).isNotNull()).select(own_level(box).alias("k")).distinct().collect())


def ladder(levels: list[int]) -> list[int]:
    """The levels and, above them, every sixth up to sizes that hold anything: a list for boxes that were not looked at."""
    top = max(levels, default=0)
    return sorted({*levels, *range(top + 6, top + 60, 6)})


def level_in(box: str, levels: list[int]) -> Column:
    """The first level listed whose cells are as large as the box."""
    listed = F.array(*[F.lit(k) for k in levels])
    own = own_level(box)
    return F.coalesce(F.array_min(F.filter(listed, lambda k: k >= own)), F.lit(max(levels, default=LOWEST)))


def cell_levels(df: DataFrame, box: str, levels: list[int], occupied: int | None = None, level: str = "_own", out: str = "cell") -> DataFrame:
    """One row for each cell (struct<k, i, j>) that the box touches on its own level and, of ``levels``, on those above.

    ``level`` gets the own level. Levels above ``occupied`` are left out but for the own one: the other side has nothing
    of its own there.
    """
    listed = F.array(*[F.lit(k) for k in levels])
    at = df.where(F.col(box).isNotNull()).withColumn(level, level_in(box, levels))
    more = F.lit(True) if occupied is None else None
    at = at.withColumn("_k", F.explode(F.filter(listed, lambda k: (k == F.col(level)) | ((k > F.col(level)) & (more if more is not None else k <= occupied)))))
    side = F.pow(F.lit(2.0), F.col("_k"))
    low = lambda c: F.floor(F.col(f"{box}.{c}") / side)
    at = at.withColumn("_i", F.explode(F.sequence(low("xmin"), low("xmax")))).withColumn("_j", F.explode(F.sequence(low("ymin"), low("ymax"))))
    return at.withColumn(out, F.struct(F.col("_k").alias("k"), F.col("_i").alias("i"), F.col("_j").alias("j"))).drop("_k", "_i", "_j")


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer's estimate of the frame lies below the limit; unknown sizes are estimated as huge."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return (size if isinstance(size, int) else size.longValue()) <= limit
