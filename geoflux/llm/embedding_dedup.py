"""Near duplicates among embeddings by product quantisation with exact rerank.

Coarse inverted lists and codes of residual subspaces are fitted on a bounded
sample; every vector is indexed. A vector probes every list whose cell and
shell can hold a vector within the radius, so no list is left out by a count.
Distances to the members of a list come from tables by their codes. A member
whose table distance exceeds the radius by more than its own known
quantisation error cannot be a neighbour, so the lookup loses nothing; half of
the tables rule out most members, as the other half has a bound by norms. What
remains is held to the exact cosine in double precision.

Near lists form groups, cut into chunks of members and of queries, so no task
holds a whole group; a pair meets in one task, which returns counts and a
spanning forest of its links, never all pairs. Equal vectors are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Scratch, components

#: Rows of the sample on which lists and codes are fitted; the driver holds them.
SAMPLE = 16_384
MAX_LISTS = 1024
SUBSPACES, CODES = 16, 256
#: Members and queries that meet in a task at once, and queries and members that it looks up at a time: few enough for the processor's caches.
CHUNK, ASKED, STEP = 8192, 1024, 64
#: Parts into which the rows of equal vectors are cut.
SALTS = 32


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    d = (centres**2).sum(1) - 2 * x @ centres.T
    if k == 1:
        return d.argmin(1)[:, None]
    k = min(k, len(centres))
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1), 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)[:, 0]
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centres and codebooks of the residual's subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.coarse = _kmeans(sample, lists, 8, rng)
        r = sample - self.coarse[_nearest(sample, self.coarse)[:, 0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(r[:, c], CODES, 6, rng) for c in self.cuts]

    def reach(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, shells: np.ndarray, radius: float) -> np.ndarray:
        """Whether a list can hold a vector within the radius of a row, for rows (in the cells ``own``) and lists.

        The members of a list are nearer to its centre than to the row's own, so they lie beyond the plane between
        the two; and their distances from its centre lie between the bounds in ``shells``.
        """
        c, mine = self.coarse[lists], self.coarse[own]
        to = ((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T).clip(0)
        gap = np.sqrt(((mine**2).sum(1)[:, None] + (c**2).sum(1) - 2 * mine @ c.T).clip(1e-12))
        plane = (to - ((x - mine) ** 2).sum(1)[:, None]) / (2 * gap)
        far = np.sqrt(to)
        return (plane <= radius + 1e-6) & (far <= shells[lists, 1] + radius + 1e-6) & (far >= shells[lists, 0] - radius - 1e-6)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the quantisation error of each vector."""
        r = x - self.coarse[lists]
        codes = np.stack([_nearest(r[:, c], b)[:, 0] for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((r - back) ** 2).sum(1))

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Products of the queries with the codes of each subspace; they serve all lists."""
        return [(b @ queries[:, c].T).astype(np.float32) for c, b in zip(self.cuts, self.books, strict=True)]

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: each end but the least of its component, and that least end."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    child = np.nonzero(root != np.arange(len(ids)))[0]
    return ids[child], ids[root[child]]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors``: (id, n_links long, component_id long, kept boolean).

    Pairs with cosine >= ``cosine`` link; both ends count a found link.
    Vectors of different lengths do not link; each length has an index of its
    own. Vectors that are null, zero or empty, or hold null or non-finite
    components, link with nothing; so do rows with a null id. Ids are integers;
    equal vectors of different ids link, repeated rows are one vector, and an
    id with several vectors has the links of each on its row. Other columns are
    not read. An empty table gives an empty table.
    """
    spark = ship(vectors.sparkSession)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    finite = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    usable = F.coalesce(finite, F.lit(False)) & F.col("id").isNotNull()
    good = rows.where(usable)
    out = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    sizes = sorted(r.d for r in good.select(F.size("v").alias("d")).distinct().collect())  # a row a length
    for d in sizes:
        out = out.union(_of_length(good if len(sizes) == 1 else good.where(F.size("v") == d), d, cosine, scratch))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def _of_length(good: DataFrame, dim: int, cosine: float, scratch: Scratch) -> DataFrame:
    """(id, n, component) of vectors of one length."""
    spark = good.sparkSession
    once = good
    if good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        once = good.distinct()
    # Rows of equal vectors meet their class in parts, by hashes of their ids.
    parts = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {SALTS}) as int))")).alias("parts")
    classes = scratch.save(once.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("w"), parts))
    total = classes.count()
    sample = classes.select("v").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect() if total > SAMPLE else classes.select("v").collect()  # at most SAMPLE rows
    x = _unit(np.array([r.v for r in sample]))
    index = Index(x, min(MAX_LISTS, max(4, int(total**0.5))))
    shared = spark.sparkContext.broadcast(index)  # of a size bounded by MAX_LISTS and CODES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                raw = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                u = _unit(raw)
                own = _nearest(u, shared.value.coarse)[:, 0].astype(np.int32)
                codes, error = shared.value.encode(u, own)
                depth = np.sqrt(((u - shared.value.coarse[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(depth)],
                    names=["rep", "w", "u", "own", "codes", "error", "depth"],
                )

    placed = scratch.save(classes.select("v", "rep", "w").mapInArrow(place, "rep long, w long, u binary, own int, codes binary, error double, depth double"))
    filled = placed.groupBy("own").agg(F.count("*").alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("hi")).collect()  # at most MAX_LISTS rows
    # Lists of near centres share a group, so a row goes to a group once for all lists that it probes there.
    n_groups = min(len(index.coarse), -(-total // CHUNK))
    group = _nearest(index.coarse, _kmeans(index.coarse, n_groups, 8, np.random.default_rng(5)))[:, 0]
    shells = np.full((len(index.coarse), 2), [np.inf, -np.inf])
    sizes_of = dict.fromkeys(group.tolist(), 0)
    for r in filled:
        shells[r.own] = r.lo, r.hi
        sizes_of[int(group[r.own])] += r.n
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the groups that hold a list in reach; a pair of groups meets in the later one."""
        which = [(g, np.nonzero(group == g)[0]) for g in sorted(sizes_of)]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                u = np.frombuffer(b"".join(part.column(0).to_pylist()), np.float64).reshape(part.num_rows, -1)
                own = part.column(1).to_numpy()
                near = np.stack([(g >= group[own]) & shared.value.reach(u, own, lists, shells, radius).any(1) for g, lists in which], 1)
                at = pa.array([[which[k][0] for k in np.nonzero(row)[0]] for row in near], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(2), at], names=["rep", "groups"])

    groups = scratch.save(placed.select("u", "own", "rep").mapInArrow(ask, "rep long, groups array<int>"))
    asked = {r.at: r.n for r in groups.select(F.explode("groups").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()}  # a row a group
    chunks = [(g, -(-n // CHUNK), -(-asked.get(g, 1) // CHUNK)) for g, n in sizes_of.items() if n]
    chunks = F.broadcast(spark.createDataFrame(chunks, "at int, nm int, nq int"))
    in_group = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "own int, at int"))
    h = F.xxhash64("rep")
    shared_columns = ["rep", "w", "u", "own", "codes", "error"]
    left = placed.join(in_group, "own").join(chunks, "at").withColumn("i", F.pmod(h, "nm").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, nq - 1)")))
    right = placed.join(groups, "rep").withColumn("at", F.explode("groups")).join(chunks, "at").withColumn("j", F.pmod(h, "nq").cast("int")).withColumn("i", F.explode(F.expr("sequence(0, nm - 1)")))
    both = left.select("at", "i", "j", F.lit(True).alias("member"), *shared_columns).union(right.select("at", "i", "j", F.lit(False).alias("member"), *shared_columns))

    def pairs(t: pa.Table) -> pa.Table:
        is_member = t["member"].to_numpy(zero_copy_only=False)
        order = np.argsort(t["rep"].to_numpy(), kind="stable")
        m, q = order[is_member[order]], order[~is_member[order]]
        none = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(m) or not len(q):
            return none
        block = lambda name, kind, rows: np.frombuffer(b"".join(t[name].take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1)
        own, rep, w = (t[c].to_numpy() for c in ("own", "rep", "w"))
        m = m[np.argsort(own[m], kind="stable")]  # members list by list
        um, uq, codes, error = block("u", np.float64, m), block("u", np.float64, q), block("codes", np.uint8, m), t["error"].to_numpy()[m]
        known, lists = shared.value, np.unique(own[m])
        back = known.decode(codes, own[m])
        # A table distance is at most the radius and the member's error just where the product is at least this.
        need = ((1 + (back**2).sum(1) - (radius + error) ** 2) / 2 - 1e-4).astype(np.float32)
        reach = known.reach(uq, own[q], lists, shells, radius)
        half = max(1, len(known.cuts) // 2)
        first = known.cuts[half - 1][-1] + 1  # dimensions that the first half of the tables has
        rest_m = np.sqrt((back[:, first:] ** 2).sum(1)).astype(np.float32)
        n_q, n_m = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
        ends = [(none["a"].to_numpy(), none["b"].to_numpy())]
        inside = group[own[q]] == int(t["at"][0].as_py())
        starts = np.searchsorted(own[m], lists, "left").tolist() + [len(m)]
        for asked in np.array_split(np.arange(len(q)), -(-len(q) // ASKED)):
            tables = known.tables(uq[asked])
            centre = (known.coarse[lists][:, :first] @ uq[asked, :first].T).astype(np.float32)
            centre_rest = (known.coarse[lists][:, first:] @ uq[asked, first:].T).astype(np.float32)
            rest_q = np.sqrt((uq[asked, first:] ** 2).sum(1)).astype(np.float32)
            for k in range(len(lists)):
                at = np.nonzero(reach[asked, k])[0]
                if len(at) == 0:
                    continue
                every = 2 * len(at) > len(asked)
                at = slice(None) if every else at
                some = tables if every else [x[:, at] for x in tables]
                near, far, qs = centre[k, at], centre_rest[k, at], asked[at]
                bound = rest_q[at].max() * (1 + 1e-6)
                for lo in range(starts[k], starts[k + 1], STEP):
                    ms = np.arange(lo, min(lo + STEP, starts[k + 1]))
                    dot = some[0][codes[ms, 0]]
                    dot += near
                    for i in range(1, half):
                        dot += some[i][codes[ms, i]]
                    mi, qi = np.nonzero(dot >= (need[ms] - rest_m[ms] * bound - 1e-5)[:, None])
                    if len(qi) * 16 > dot.size:
                        dot += far
                        for i in range(half, len(some)):
                            dot += some[i][codes[ms, i]]
                        mi, qi = np.nonzero(dot >= need[ms][:, None])
                    elif len(qi):
                        full = dot[mi, qi] + far[qi]
                        for i in range(half, len(some)):
                            full += some[i][codes[ms[mi], i], qi]
                        keep = full >= need[ms[mi]]
                        mi, qi = mi[keep], qi[keep]
                    # Within a group both rows ask for each other: one of the two counts, and none for itself.
                    once = ~inside[qs[qi]] | (rep[q][qs[qi]] < rep[m][ms[mi]])
                    mi, qi = mi[once], qi[once]
                    if len(qi) == 0:
                        continue
                    if len(qi) * 16 > dot.size:
                        keep = (um[ms] @ uq[qs].T)[mi, qi] >= cosine
                    else:
                        keep = np.einsum("ij,ij->i", uq[qs[qi]], um[ms[mi]]) >= cosine
                    mi, qi = ms[mi[keep]], qs[qi[keep]]
                    if len(qi):
                        n_q += np.bincount(qi, w[m][mi], len(q)).astype(np.int64)
                        n_m += np.bincount(mi, w[q][qi], len(m)).astype(np.int64)
                        ends.append(_forest(rep[q][qi], rep[m][mi]))
        a, b = _forest(*(np.concatenate(e) for e in zip(*ends, strict=True)))
        ids, n = np.concatenate([rep[q], rep[m]]), np.concatenate([n_q, n_m])
        ids, n = ids[n > 0], n[n > 0]
        kind = np.repeat(np.array([0, 1], np.int32), [len(ids), len(a)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([ids, a]), pa.int64()), "b": pa.array(np.concatenate([n, b]), pa.int64())})

    found = scratch.save(both.groupBy("at", "i", "j").applyInArrow(pairs, "kind int, a long, b long"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    label = components(found.where("kind = 1").select("a", "b"), scratch)
    salts = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(parts, i) = 1)")).alias("salt")
    of_class = (
        classes.join(counts, "rep", "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", salts, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    return good.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(of_class, ["v", "salt"]).select("id", "n", "component")


def op10(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id
"""
