"""Relation and distance joins.

Both sides get their bounding boxes once. A side that is provably small is
broadcast whole; otherwise boxes meet in the cells of a hierarchy of grids, by
an equi-join that Spark can shuffle, split when skewed, and spill. A pair that
meets in several cells counts in one of them, found from its boxes alone.
What meets is held to the boxes and then to the exact predicate.

Outer, semi and anti joins are left to the planner, which gives the side that
is kept one key a row: such a join needs no ids and looks at no side twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import call
from ..plans.grid import BROADCAST_BYTES, LOWEST, bounds, cell_levels, ladder, levels_of, small_enough
from ..plans.stable import stable

PREDICATES = ("intersects", "contains", "within", "covers", "coveredby", "touches", "crosses", "overlaps", "equals")
HOW = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right", "full": "full", "outer": "full", "full_outer": "full",
    "left_semi": "left_semi", "semi": "left_semi", "left_anti": "left_anti", "anti": "left_anti", "right_semi": "right_semi", "right_anti": "right_anti", "left_mark": "left_mark",
}


def _column(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _boxed(df: DataFrame, side: str, geom: str | Column, box: Column | None, grow: Column | None) -> DataFrame:
    """(l_row, l_geom, l_box, l_id): the whole row as a struct, so that no name can clash."""
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"{side}_row"),
        _column(geom).alias(f"{side}_geom"),
        (box if box is not None else bounds(_column(geom))).alias(f"{side}_box"),
        F.monotonically_increasing_id().alias(f"{side}_id"),
        *([grow.cast("double").alias("by")] if grow is not None else []),
    )
    if grow is not None:
        b = F.col(f"{side}_box")
        out = out.withColumn(
            f"{side}_box",
            F.when(b.isNotNull() & (F.col("by") >= 0), F.struct((b.xmin - F.col("by")).alias("xmin"), (b.ymin - F.col("by")).alias("ymin"), (b.xmax + F.col("by")).alias("xmax"), (b.ymax + F.col("by")).alias("ymax"))),
        )
    return out


PLANNED = {"left": "left", "right": "right", "left_semi": "left_semi", "left_anti": "left_anti", "right_semi": "left_semi", "right_anti": "left_anti"}


def _planned(left: DataFrame, right: DataFrame, exact: Column, how: str, lcols: list[str], rcols: list[str], suffix: str) -> DataFrame:
    l, r = left.drop("l_box", "l_id"), right.drop("r_box", "r_id")
    swapped = how in ("right_semi", "right_anti")
    out = r.join(l, exact, PLANNED[how]) if swapped else l.join(r, exact, PLANNED[how])
    names = {c.lower() for c in lcols}
    lsel = [F.col(f"l_row.`{c}`").alias(c) for c in lcols]
    if swapped:
        return out.select(*[F.col(f"r_row.`{c}`").alias(c) for c in rcols])
    return out.select(*lsel, *([F.col(f"r_row.`{c}`").alias(c if c.lower() not in names else c + suffix) for c in rcols] if how in ("left", "right") else []))


def _joined(left: DataFrame, right: DataFrame, exact: Column, how: str, lcols: list[str], rcols: list[str], suffix: str, limit: int) -> DataFrame:
    if how in PLANNED:
        return _planned(left, right, exact, how, lcols, rcols, suffix)
    if how != "inner":  # sides that the join looks at twice keep the ids of their rows
        left = stable(left)
        right = stable(right) if how == "full" else right
    return _finish(_pairs(left, right, exact, limit), left, right, how, lcols, rcols, suffix)


def _pairs(left: DataFrame, right: DataFrame, exact: Column, limit: int) -> DataFrame:
    """The pairs of boxed sides that pass the exact test, each once."""
    meet = F.expr("l_box.xmin <= r_box.xmax and r_box.xmin <= l_box.xmax and l_box.ymin <= r_box.ymax and r_box.ymin <= l_box.ymax")
    # A pair meets on the larger of its two levels, in the cell of the lower left corner of what the boxes share.
    once = F.expr(
        "l.cell.k = greatest(l_k, r_k) and l.cell.i = floor(greatest(l_box.xmin, r_box.xmin) / pow(2D, l.cell.k)) and l.cell.j = floor(greatest(l_box.ymin, r_box.ymin) / pow(2D, l.cell.k))"
    )
    on = (F.col("l.cell") == F.col("r.cell")) & meet & once & exact
    for small, large, s, g in ((right, left, "r", "l"), (left, right, "l", "r")):
        if small_enough(small, limit):  # of a size that the optimizer has checked; the large side is read once and not moved
            own = levels_of(small, f"{s}_box")
            levels = ladder(own)
            few = cell_levels(small, f"{s}_box", levels, level=f"{s}_k").alias(s)
            many = cell_levels(large, f"{g}_box", levels, max(own, default=0), f"{g}_k").alias(g)
            return many.join(F.broadcast(few), on).drop("cell", "l_k", "r_k")
    ll, rl = levels_of(left, "l_box"), levels_of(right, "r_box")
    levels = sorted({*ll, *rl}) or [0]
    lc = cell_levels(left, "l_box", levels, max(rl, default=LOWEST), "l_k")
    rc = cell_levels(right, "r_box", levels, max(ll, default=LOWEST), "r_k")
    return lc.alias("l").join(rc.alias("r"), on).drop("cell", "l_k", "r_k")


def _finish(pairs: DataFrame, left: DataFrame, right: DataFrame, how: str, lcols: list[str], rcols: list[str], suffix: str) -> DataFrame:
    names = {c.lower() for c in lcols}
    lsel = [F.col(f"l_row.`{c}`").alias(c) for c in lcols]
    rsel = [F.col(f"r_row.`{c}`").alias(c if c.lower() not in names else c + suffix) for c in rcols]
    if how == "inner":
        return pairs.select(*lsel, *rsel)
    if how == "left_mark":
        hit = pairs.select("l_id").distinct().withColumn("mark", F.lit(True))
        return left.join(hit, "l_id", "left").select(*lsel, F.coalesce("mark", F.lit(False)).alias("mark"))
    out = pairs.select("l_row", "r_row")
    rest = left.join(pairs.select("l_id").distinct(), "l_id", "left_anti")
    out = out.unionByName(rest.select("l_row"), allowMissingColumns=True)
    rest = right.join(pairs.select("r_id").distinct(), "r_id", "left_anti")
    out = out.unionByName(rest.select("r_row"), allowMissingColumns=True)
    return out.select(*lsel, *rsel)


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", left_geom: str | Column = "geometry", right_geom: str | Column = "geometry",
                 how: str = "inner", condition: str | None = None, left_box: Column | None = None, right_box: Column | None = None, suffix: str = "_right",
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``left JOIN right ON ST_<predicate>(left_geom, right_geom) [AND condition]``.

    ``how`` is inner, left, right, full, left_semi, left_anti, right_semi,
    right_anti or left_mark (left rows and a boolean ``mark``). Null and empty
    geometries match nothing. Columns of the right side whose names the left
    side has get ``suffix``. ``condition`` is SQL over ``l_row`` and ``r_row``.
    Boxes can be given, from plain numbers, where they are known; inner joins use them.
    """
    predicate = predicate.lower().removeprefix("st_")
    if predicate not in PREDICATES:
        raise ValueError(f"not a predicate of spatial joins: {predicate}; they are {', '.join(PREDICATES)}")
    if how not in HOW:
        raise ValueError(f"not a kind of join: {how}")
    lb, rb = _boxed(left, "l", left_geom, left_box, None), _boxed(right, "r", right_geom, right_box, None)
    exact = call(f"st_{predicate}", "l_geom", "r_geom")
    if condition:
        exact = exact & F.expr(condition)
    return _joined(lb, rb, exact, HOW[how], left.columns, right.columns, suffix, broadcast_bytes)


def distance_join(left: DataFrame, right: DataFrame, distance: float | str | Column, left_geom: str | Column = "geometry", right_geom: str | Column = "geometry",
                  how: str = "inner", strict: bool = False, condition: str | None = None, suffix: str = "_right", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``left JOIN right ON ST_DWithin(left_geom, right_geom, distance)``, or ST_Distance < distance if ``strict``.

    ``distance`` is a number or a column of the left side. Null or negative
    distances match nothing.
    """
    by = F.lit(float(distance)) if isinstance(distance, (int, float)) else _column(distance)
    lb, rb = _boxed(left, "l", left_geom, None, by), _boxed(right, "r", right_geom, None, None)
    exact = call("st_distance", "l_geom", "r_geom") < F.col("by") if strict else call("st_dwithin", "l_geom", "r_geom", F.col("by"))
    if condition:
        exact = exact & F.expr(condition)
    return _joined(lb, rb, exact, HOW[how], left.columns, right.columns, suffix, broadcast_bytes)
