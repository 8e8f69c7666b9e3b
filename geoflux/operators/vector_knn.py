"""Nearest neighbours among vectors, ranked in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship

#: Queries and candidates that meet in a task at once.
QUERIES, CANDIDATES = 512, 8192


def vector_knn(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (q, v): the ids of the ``k`` rows of ``vectors`` nearest to each row of ``queries``, by Euclidean distance and then id.

    Both sides are cut into blocks; a block of queries and a block of
    candidates keep the k best of each query, which are ranked once more. Ids
    are integers and unique. A distance that is null or not a number ranks last.
    """
    ship(vectors.sparkSession)
    n_q, n_v = -(-queries.count() // QUERIES) or 1, -(-vectors.count() // CANDIDATES) or 1
    side = lambda d, asks: d.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("e"), F.lit(asks).alias("asks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    both = side(queries, True).withColumn("i", block(n_q)).withColumn("j", every(n_v)).union(side(vectors, False).withColumn("i", every(n_q)).withColumn("j", block(n_v)))

    def best(t: pa.Table) -> pa.Table:
        ids, asks, rows = t["id"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False), t["e"].to_pylist()
        width = max((len(r) for r in rows if r is not None), default=0)
        x = np.array([[np.nan] * width if r is None else r for r in rows], np.float64).reshape(len(rows), width)
        of, near, far = [], [], []
        candidates, named = x[~asks], ids[~asks]
        for q, e in zip(ids[asks], x[asks], strict=True):
            d = np.sqrt(((candidates - e) ** 2).sum(1))
            first = np.lexsort((named, d))[:k]
            of.append(np.full(len(first), q)), near.append(named[first]), far.append(d[first])
        whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        return pa.table({"q": whole(of, np.int64), "v": whole(near, np.int64), "far": whole(far, np.float64)})

    rank = F.row_number().over(Window.partitionBy("q").orderBy("far", "v"))
    return both.groupBy("i", "j").applyInArrow(best, "q long, v long, far double").withColumn("r", rank).where(F.col("r") <= k).select("q", "v")
