"""Uniform shuffle into shards of exact size, in DataFrame functions only.

A communication matrix says how many rows each block of the input sends to
each shard. Drawn from the multivariate hypergeometric law with both margins
fixed, it is what a uniform random permutation of all rows would give. Rows
are then permuted inside their block (the first counts of the permutation go
to shard 0, the next to shard 1, ...), exchanged, and permuted again inside
their shard. The result is a uniform shuffle whose shards differ by one row
at most.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, without

#: Largest number of blocks: bounds what the driver holds and broadcasts (blocks x shards counts).
MAX_BLOCKS = 16384
#: Largest number of slots' buckets a shard; bounds the offsets table.
MAX_BUCKETS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """An exact draw of the number of good ones among n taken, by inversion outward from the mode."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u = rng.random() - p
    if u <= 0:
        return mode
    up, down, pu, pd = mode, mode, p, p
    while up < hi or down > lo:
        if up < hi:
            pu *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, from the multivariate hypergeometric law."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        line, rest, need = [], sum(left), n
        for j, c in enumerate(left):
            x = hypergeometric(rng, c, rest - c, need) if need else 0
            line.append(x)
            rest -= c
            need -= x
            left[j] -= x
        out.append(line)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def shard(rows: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 20_000) -> DataFrame:
    """Columns (id, size, text_crc32, shard int, slot long), one row for each row of ``rows``.

    ``size`` is the UTF-8 bytes of the text plus 1, a null text counting as
    none (its crc is 0). Any id, null too, is allowed; repeated rows are dealt
    like others and get slots of their own. An empty table gives an empty
    table. Other columns are not read. The same rows and seed give the same
    shards whatever the partitioning of the input; equal rows can trade slots.
    Blocks hold about ``rows_per_block`` rows, up to 16,384 blocks.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long"))
    base = rows.select(key.alias("id"), size.alias("size"), crc.alias("text_crc32"))
    total = rows.select(F.count("*")).head()[0]
    blocks = min(MAX_BLOCKS, max(64, -(-total // rows_per_block)))
    h = lambda k: F.xxhash64(F.lit(seed * 8 + k), "id", "text_crc32", "size")
    base = scratch.save(base.withColumn("block", F.pmod(h(1), F.lit(blocks)).cast("int")))
    counts = {r.block: r.n for r in base.groupBy("block").agg(F.count("*").alias("n")).collect()}  # at most MAX_BLOCKS rows
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shard_sizes(total, shards), seed)
    ends = []
    for b, line in enumerate(matrix):
        upto, x = [], 0
        for n in line:
            x += n
            upto.append(x)
        ends.append((b, upto))
    ends = spark.createDataFrame(ends, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    local = Window.partitionBy("block").orderBy(h(2), "id", "text_crc32", "size")
    dealt = (
        base.withColumn("r", F.row_number().over(local).cast("long") - 1)
        .join(F.broadcast(ends), "block")  # at most MAX_BLOCKS x shards counts
        .select("id", "size", "text_crc32", F.expr("size(filter(ends, e -> e <= r))").alias("shard"), h(3).alias("h"))
    )
    buckets = 1 << max(3, min(MAX_BUCKETS.bit_length() - 1, (total // shards // rows_per_block).bit_length()))
    # The top bits of the second hash cut each shard into runs of the permutation, so that no task holds a whole shard.
    dealt = scratch.save(dealt.withColumn("bucket", F.shiftright("h", 64 - buckets.bit_length() + 1)))
    runs = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "id", "text_crc32", "size")
    return (
        dealt.withColumn("k", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])  # at most shards x MAX_BUCKETS rows
        .select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("k")).alias("slot"))
        .withColumnRenamed("id", id_col)
    )


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 17, id_col: str = "doc_id", **how) -> None:
    """Writes whole rows as Parquet folders ``shard=N``, sorted by slot. ``id_col`` must be unique."""
    where = shard(rows, shards, seed, id_col, **how).select(id_col, "shard", "slot")
    out = without(rows, "shard", "slot").join(where, id_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
