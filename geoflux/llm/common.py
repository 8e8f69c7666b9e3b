"""Pieces that several operators share: scratch tables, hashes, components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import delete, delete_at_exit, shared_dir

#: ASCII white space, as the contracts name it: space and code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, unlike a local
    checkpoint. ``drop`` deletes a table that no later step reads; the rest, which
    the lazy result may read, goes when the application ends. If ``tidy``, the
    shuffle files of a table go as soon as it is written, not when the driver
    happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        delete_at_exit(spark, self.root)

    def save(self, df: DataFrame, *more: DataFrame) -> DataFrame:
        """The frame, and more of its schema, written one after the other into one table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with setting(self.spark, CLEANUP, "true") if self.tidy else contextlib.nullcontext():
            for part in (df, *more):
                part.write.mode("append").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._scratch_path)


def bloom_joins(spark: SparkSession):  # noqa: ANN201
    """Lets the optimizer put a Bloom filter of a join's selective side (of the size that Spark bounds) before the
    exchange of the other, whatever the size of the table: few texts are then shuffled to find few among them."""
    return setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


_held: dict[str, Callable[[], None]] = {}


def using(name: str, clear: Callable[[], None]) -> None:
    """Called where a task begins to use the worker's caches of a module: those of other modules are emptied first."""
    for other in [n for n in _held if n != name]:
        _held.pop(other)()
        release()
    _held[name] = clear


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that a result column of the same name (in any case) replaces."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows (node, component),
    the component being the smallest node that can be reached.

    Each round a node takes the least label among its own, its label's label
    and its neighbours' labels' labels, and its root takes what its nodes have
    found, so the rounds grow with the logarithm of the longest path. The
    minima are hash aggregations with map-side combine, so a node of any degree
    is fine. Labels stay distributed; the driver sees one count a round.
    """
    e = edges.where("a <> b").select("a", "b")
    both = scratch.save(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("f")))
    for _ in range(max_rounds):
        upper = labels.select(F.col("node").alias("f"), F.col("f").alias("g"))
        two = scratch.save(labels.join(upper, "f").select("node", "f", "g"))
        near = scratch.save(both.join(two.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("near")))
        known = two.join(near, "node").select("node", "f", "g", "near")
        hooks = known.groupBy(F.col("f").alias("node")).agg(F.min("near").alias("hook"))
        new = known.join(hooks, "node", "left").select("node", F.least("f", "g", "near", F.coalesce("hook", "f")).alias("f"), F.col("f").alias("old"))
        new = scratch.save(new)
        changed = new.where("f <> old").limit(1).count()
        scratch.drop(labels, two, near)
        labels = new.select("node", "f")
        labels._scratch_path = new._scratch_path
        if not changed:
            scratch.drop(both)
            return labels.withColumnRenamed("f", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
