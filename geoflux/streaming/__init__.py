"""Spatial work on streams. Functions are ordinary expressions and need nothing; joins meet a static side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import call
from ..plans.grid import bounds, cell_levels, ladder, levels_of, small_enough


def join_static(stream: DataFrame, static: DataFrame, predicate: str = "intersects", stream_geom: str = "geometry", static_geom: str = "geometry") -> DataFrame:
    """Inner spatial join of a stream with a static frame; stateless, so any output mode will do.

    Rows meet in the cells of the static side's levels.
    """
    s = static.select(F.struct(*[F.col(f"`{c}`") for c in static.columns]).alias("r_row"), F.col(static_geom).alias("r_geom"), bounds(F.col(static_geom)).alias("r_box"))
    q = stream.select(F.struct(*[F.col(f"`{c}`") for c in stream.columns]).alias("l_row"), F.col(stream_geom).alias("l_geom"), bounds(F.col(stream_geom)).alias("l_box"))
    meet = F.expr("l_box.xmin <= r_box.xmax and r_box.xmin <= l_box.xmax and l_box.ymin <= r_box.ymax and r_box.ymin <= l_box.ymax")
    exact = call(f"st_{predicate.removeprefix('st_')}", "l_geom", "r_geom")
    names = {c.lower() for c in stream.columns}
    own = levels_of(s, "r_box")
    levels = ladder(own)
    once = F.expr("l.cell.k = greatest(l_k, r_k) and l.cell.i = floor(greatest(l_box.xmin, r_box.xmin) / pow(2D, l.cell.k)) and l.cell.j = floor(greatest(l_box.ymin, r_box.ymin) / pow(2D, l.cell.k))")
    cells = cell_levels(s, "r_box", levels, level="r_k").alias("r")
    # A small static side is broadcast with its cells; else both sides go to the cells.
    cells = F.broadcast(cells) if small_enough(s) else cells
    pairs = cell_levels(q, "l_box", levels, max(own, default=0), "l_k").alias("l").join(cells, (F.col("l.cell") == F.col("r.cell")) & meet & once & exact)
    return pairs.select(*[F.col(f"l_row.`{c}`").alias(c) for c in stream.columns], *[F.col(f"r_row.`{c}`").alias(c if c.lower() not in names else c + "_right") for c in static.columns])


def windowed(stream: DataFrame, time: str, late: str, size: str, keys: list[str], **aggregates) -> DataFrame:
    """Event-time windows with a watermark."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``work`` on each micro-batch, for operators that need a finite frame (outer and nearest-neighbour joins)."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
