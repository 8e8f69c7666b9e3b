"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one of target texts
(labelled good), one of all raw texts. The log importance weight of a text is
the sum, over its n-grams, of how much likelier the target model makes each
than the raw model, less a cut for each n-gram. Gumbel top-k draws the texts to
keep: standard Gumbel noise is added to the log weights and the k largest stay,
which draws k texts without replacement in proportion to their weights. The
rest is rejected. The cut is calibrated on the labelled rows, and k is the
number of texts of positive log weight unless it is given.

The n-grams are byte trigrams, and pairs of word shapes (case, end
punctuation, whether a word repeats the one before).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Scratch, release, using, without

TRIGRAMS, SHAPES = 1 << 16, 1 << 11
#: Labelled rows of each class that are used, those of least hash; they are broadcast.
LABELLED = 20_000
#: Neutral n-grams added to each text, so that very short texts are not judged on a few n-grams.
NEUTRAL = 50.0
#: A labelled good text that is lost weighs as much as this many bad ones that pass.
LOSS = 3
_END = {c: i for i, c in enumerate(".,;:!?|#$%&*", 1)}


class _Word(dict):
    """Of a word: 40 bits of hash and its shape."""

    def __missing__(self, w: str) -> int:
        from xxhash import xxh3_64_intdigest

        case = 0 if not any(map(str.isalpha, w)) else 1 if w.islower() else 2 if w[:1].isupper() and w[1:].islower() else 3 if len(w) > 1 and w.isupper() else 2 if w.isupper() else 4
        v = self[w] = (xxh3_64_intdigest(w.encode("utf-8", "replace")) & (1 << 40) - 1) << 7 | case << 4 | min(_END.get(w[-1], 0), 15)
        return v


_words = _Word()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams and of the shape pairs of a whole text."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    tri = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)) if len(b) > 2 else np.empty(0, np.uint32)
    if len(_words) > 200_000:
        _words.clear()
    w = text.split()
    v = np.fromiter(map(_words.__getitem__, w), np.int64, len(w))
    pair = ((v[:-1] & 7 << 4) >> 4 | (v[1:] & 127) << 3 | (v[1:] == v[:-1]).astype(np.int64) << 10) if len(v) > 1 else np.empty(0, np.int64)
    return tri, pair


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all buckets over the raw texts and the target texts; docs: (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality", _words.clear)
        both = np.zeros((2, TRIGRAMS + SHAPES), np.int64)
        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tri, pair = features(t.as_py() or "")
                for k in range(1 + (label == 1)):
                    both[k, :TRIGRAMS] += np.bincount(tri, minlength=TRIGRAMS) if len(tri) > 4096 else 0
                    if len(tri) <= 4096:
                        np.add.at(both[k], tri, 1)
                    np.add.at(both[k], pair + TRIGRAMS, 1)
        _words.clear()
        release()
        at = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both[0, at]), pa.array(both[1, at])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # TRIGRAMS + SHAPES rows at most
    raw, target = np.zeros(TRIGRAMS + SHAPES), np.zeros(TRIGRAMS + SHAPES)
    for bucket, r, t in rows:
        raw[bucket], target[bucket] = r, t
    return raw, target


def _log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    out = np.empty(len(raw))
    for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, None)):
        r, t = raw[part], target[part]
        p = (r + 0.5) / (r + 0.5).sum()
        # The target is smoothed towards the raw model, so that n-grams that it has not shown weigh little either way where rare.
        out[part] = np.log((t + 5 * p * len(r) ** 0.5) / (t.sum() + 5 * len(r) ** 0.5) / p)
    return out


class Model:
    """Log ratios by bucket."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def mean(self, text: str | None) -> tuple[float, int]:
        """Mean log ratio over trigrams plus that over shape pairs, and the number of trigrams; (-1e9, 0) without words."""
        if not text or not text.strip():
            return -1e9, 0
        tri, pair = features(text)
        return float(self.weights[tri].sum() / (len(tri) + NEUTRAL) + self.weights[pair + TRIGRAMS].sum() / (len(pair) + NEUTRAL / 5)), len(tri)


def gumbel(key: Column, seed: int = 11) -> Column:
    """Standard Gumbel noise that depends on the key and seed alone, so that a lost task draws the same again."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of the column ``key``, exactly, by counting in ever finer bins; the driver sees 1,024 counts a step."""
    low, high = values.agg(F.min("key"), F.max("key")).head()
    while True:
        inside = values.where((F.col("key") >= low) & (F.col("key") <= high))
        if high <= low:
            return low
        step = (high - low) / 1024
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(1023)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b.lo):
            if k <= b.n:
                break
            k -= b.n
        low, high = b.lo, b.hi
        if b.n <= 1024:
            return sorted((r.key for r in values.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)[k - 1]


def _score(docs: DataFrame, shared, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus _mean and _size."""
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"_mean": F.lit(0.0), "_size": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality", _words.clear)
        model = shared.value
        for batch in batches:
            both = [model.mean(t.as_py()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([m for m, _ in both], pa.float64()), pa.array([n for _, n in both], pa.int64())], names=[f.name for f in schema]
            )
        _words.clear()
        release()

    return docs.mapInArrow(run, schema)


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut between labelled means at which lost good ones, each ``LOSS`` times, and passed bad ones are fewest; without
    bad ones the cut that 99 of 100 good ones pass, without good ones none."""
    if len(good) == 0:
        return -np.inf
    if len(bad) == 0:
        return float(np.quantile(good, 0.01))
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(good, cuts) / len(good)  # good ones below a cut
    passed = 1 - np.searchsorted(bad, cuts) / len(bad)
    best = int(np.argmin(LOSS * lost + passed))
    return float((cuts[best - 1] + cuts[best]) / 2 if best else cuts[best] - 0.5)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, cut: float | None = None,
             columns: list[str] | None = None, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` plus log_weight double, key double and kept boolean.

    ``k`` rows are drawn (all rows of positive weight count if it is None) with
    ``cut`` for each n-gram (calibrated on the labels if it is None). The raw
    counts, the number to keep and the draw see all texts; of the labels at
    most ``LABELLED`` rows of each class are used. Without good labels nothing
    is rejected but texts without words.

    A null, empty or blank text has log_weight -1e9 and goes, whatever ``k``.
    Equal rows get equal results, and ties with the last one drawn stay; a null
    id draws one noise. ``columns`` are those of ``docs`` to return, all by
    default; columns called log_weight, key or kept are replaced. Scores are
    written once with these columns. An empty table stays empty.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark)
    docs = without(docs, "log_weight", "key", "kept", "_mean", "_size", "_label", "_id")
    columns = [c for c in (columns or docs.columns) if c in docs.columns]
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label")).where("_id is not null")
    one = scratch.save(one)
    used = [one.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(LABELLED) for c in (0, 1)]
    used = F.broadcast(scratch.save(used[0].union(used[1])))  # 2 x LABELLED rows at most
    rows = docs.join(used, F.col(f"`{id_col}`") == F.col("_id"), "left").drop("_id")
    raw, target = _counts(rows.select(F.col(f"`{text_col}`"), "_label"))
    learned = target.sum() > 0
    shared = spark.sparkContext.broadcast(Model(_log_ratio(raw, target) if learned else np.zeros(TRIGRAMS + SHAPES)))
    keep = list(dict.fromkeys([*columns, id_col]))
    scored = scratch.save(_score(rows, shared, text_col, [*keep, "_label"]))
    if cut is None:
        known = scored.where("_label is not null and _size > 0").select("_label", "_mean").collect() if learned else []  # 2 x LABELLED rows at most
        cut = calibrated(np.array([r._mean for r in known if r._label == 1]), np.array([r._mean for r in known if r._label == 0]))
    words = F.col("_mean") > -1e8
    weight = F.when(~words, -1e9).otherwise((F.col("_mean") - cut) * (F.col("_size") + NEUTRAL) if cut > -np.inf else F.lit(0.0))
    out = scored.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + gumbel(F.col(f"`{id_col}`"), seed))
    if cut == -np.inf and k is None:
        last = -np.inf
    else:
        k = out.where("log_weight > 0").count() if k is None else min(k, out.where("log_weight > -1e8").count())
        last = kth_largest(out.select("key"), k) if k else np.inf
    return out.select(*[F.col(f"`{c}`") for c in columns], "log_weight", "key", ((F.col("key") >= float(last)) & (F.col("log_weight") > -1e8)).alias("kept"))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text"), labels, columns=["doc_id"])
