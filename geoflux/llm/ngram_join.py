"""Exact Jaccard join of word shingles by universe partition and pigeonhole.

Two linked sets differ in at most H elements. If the hashed universe is cut
into segments, those differences cannot touch H+1 of them, so linked sets
agree on one segment at least among any H+1. For each band of sizes the
universe has a quarter more segments than that. Each set indexes its subset of
every segment and probes with the H+1 of least cost, the cost being the
expected length of the posting list, which falls steeply with the size of the
subset. Empty subsets, which cost most, are neither indexed nor probed. Sets
with too few subsets get a budget of one difference on the others instead: they index and
probe their one-deletion neighbourhoods.

Equal sets are one class and are joined once. In a bucket of equal
signatures, all classes are first held against one of them; only what lies in
different components after that is held pairwise, if the parities of the sets
allow a link at all. So a large group of near copies costs about one
comparison a member, and no link between components is lost. Every link is verified on the whole shingle sets.

Signatures that very many sets share are found by counts in a fixed number of
bins. Their rows are cut into parts by the hash of the set: what holds for a
signature is aggregated before the exchange and goes to its parts, and pairs
are made part by part, so no task has all rows of a signature.

Signatures meet in ``PASSES`` turns, each with those of one range, so that the
disk holds one range in shuffle files at a time; their table goes after that.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship
from .common import Scratch, bloom_joins, components, release, using

#: Segments for each one that pigeonhole needs: the rest may be left out as too frequent.
SLACK = 1.25
#: Turns in which the members of a bucket meet one centre, before what is still apart meets pairwise.
STARS = 2
#: Bins in which rows of signatures are counted, rows of a signature that one task may hold, and parts of a larger one.
BINS, LARGE, SALTS = 65_536, 1_000, 32
#: Ranges of signatures that are exchanged one after the other, a power of two.
PASSES = 4
#: Distinct words whose hashes a worker holds.
WORD_CACHE = 200_000
LARGEST = 2**40


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = self[word] = xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words are what ASCII white space divides, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower() and split() know ASCII only
    if not w:
        return np.empty(0, np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        x = h[: len(h) - k + 1] + np.uint64(k)
        for i in range(1, k):
            x = _mix(x) + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(x))


class Bands:
    """Bands of set sizes such that linked sets lie in one band or in two neighbours."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1, 2]
        while self.low[-1] < LARGEST:
            self.low.append(max(self.low[-1] + 1, 100 * (self.low[-1] - 1) // percent + 1))
        self.lows = np.array(self.low)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def differences(self, n1: int, n2: int) -> int:
        """The most elements in which linked sets of these sizes can differ."""
        return (n1 + n2) * (100 - self.percent) // (100 + self.percent)

    def most(self, band: int) -> int:
        """The most differences of linked sets in this band and the next."""
        return self.differences(self.low[band + 2] - 1, self.low[band + 2] - 1)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a set in its two bands, int64, the last bit telling probes from mere index entries."""
        n, out = len(s), []
        if n == 0:
            return np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            e = _mix(s ^ np.uint64(0x9E3779B97F4A7C15))
            for band in sorted({max(0, self.of(n) - 1), self.of(n)}):
                top = self.low[band + 2] - 1
                most = self.most(band)
                if most == 0:
                    continue  # only equal sets link here, and they are one class
                m = int(SLACK * (most + 1)) + 2
                need = self.differences(n, min(100 * n // self.percent, top)) + 1
                seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows with s, so subsets are runs
                at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
                sums, sizes, no = np.add.reduceat(e, at), np.diff(np.append(at, n)), seg[at]
                salt = np.uint64(band * 0x632BE59BD9B4E019 & (2**64 - 1))
                name = lambda total, which: _mix(total + _mix(which * np.uint64(0xD1342543DE82EF95) + salt)) & np.uint64(2**64 - 2)  # noqa: B023, E731
                full = name(sums, no)
                if len(at) >= need:
                    probe = np.zeros(len(at), np.uint64)
                    probe[np.argsort(-sizes, kind="stable")[:need]] = 1
                    out.append(full | probe)
                    continue
                back = np.repeat(np.arange(len(at)), sizes)
                out += [full | np.uint64(1), name(sums[back] - e, no[back])[sizes[back] > 1] | np.uint64(1)]
                if need - len(at) > (sizes > 1).sum():  # too few even so: all segments, empty ones too, stand as they are
                    out.append(name(np.zeros(1, np.uint64), np.setdiff1d(np.arange(m, dtype=np.uint64), no)) | np.uint64(1))
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _name(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _digests(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, cid, chk, sigs0, ...): 128 bits that name the set; signatures once for each set in a task, a column for each pass."""
    columns, shift = [f"sigs{k}" for k in range(PASSES)], np.uint64(65 - PASSES.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("ngram_join", _words.clear)
        bands, seen = Bands(percent), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, n, names, sigs = batch.slice(i, 500), [], [], []
                for t in part.column(1):
                    s = shingles(t.as_py(), words)
                    name = _name(s)
                    n.append(len(s))
                    names.append(name)
                    sigs.append(np.empty(0, np.int64) if name in seen else bands.signatures(s))
                    seen.add(name)
                two = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                every, row = np.concatenate(sigs), np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
                turn, lists = every.view(np.uint64) >> shift, []
                for k in range(PASSES):
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[turn == k], minlength=len(sigs)))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(every[turn == k])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), *lists], names=["id", "n", "cid", "chk", *columns]
                )
        _words.clear()
        release()

    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, n long, cid long, chk long, " + ", ".join(f"{c} array<long>" for c in columns))


def _parity(s: np.ndarray) -> list[int]:
    """1,024 bits, each the parity of the elements of one cell: sets differ in at least as many elements as their parities in bits."""
    odd = np.bincount((s >> np.uint64(20) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cid, text) to (cid, shingles binary, n, parity), of the texts whose set the cid names (ids can be repeated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                both = [(c, shingles(t, words)) for c, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                both = [(c, x) for c, x in both if int.from_bytes(_name(x)[:8], "little", signed=True) == c]
                sets = [x for _, x in both]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in both], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_parity(x) for x in sets], pa.list_(pa.int64()))],
                    names=["cid", "shingles", "n", "parity"],
                )
        _words.clear()
        release()

    return docs.mapInArrow(run, "cid long, shingles binary, n long, parity array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, np.empty(0, np.uint64)
            for k in range(batch.num_rows):
                a = batch.column(0)[k].as_py()
                if a != last:
                    x, last = np.frombuffer(batch.column(2)[k].as_py(), np.uint64), a
                y = np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
            yield part.filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _salt(cid: str = "cid") -> Column:
    return F.pmod(F.xxhash64(cid), F.lit(SALTS)).cast("int")


def _told(rows: DataFrame, some_large: bool, **of_sig: Column) -> DataFrame:
    """The rows plus aggregates over the rows of their signature; ``large`` tells which signatures are too large for a task."""
    by_sig = Window.partitionBy("sig")
    small = (rows.where("not large") if some_large else rows).withColumns({k: a.over(by_sig) for k, a in of_sig.items()})
    if not some_large:
        return small
    big = rows.where("large").withColumn("salt", _salt())
    parts = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cid), {SALTS}) as int))")).alias("parts")
    known = big.groupBy("sig").agg(*[a.alias(k) for k, a in of_sig.items()], parts)
    known = known.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(parts, i) = 1)"))).drop("parts")
    return small.unionByName(big.join(known, ["sig", "salt"]).drop("salt"))


def _parts(size: Column) -> Column:
    """As many parts as a signature of so many rows needs: few, so that rows are not copied much."""
    return F.least(F.lit(SALTS), F.ceil(size / LARGE)).cast("int")


def _large(sigs: list[DataFrame], scratch: Scratch) -> DataFrame | None:
    """(bin) of the bins that may hold a large signature, BINS rows at most; none if there is none."""
    rows = functools.reduce(DataFrame.unionAll, sigs)
    counts = scratch.save(rows.groupBy(F.pmod("sig", F.lit(BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n")))
    mean = (counts.agg(F.sum("n")).head()[0] or 0) / BINS
    bins = scratch.save(counts.where(F.col("n") > LARGE + 4 * mean).select("bin"))
    scratch.drop(counts)
    return bins if bins.limit(1).count() else None


def _shared(sigs: DataFrame, bins: DataFrame | None) -> DataFrame:
    """(sig, probe, cid, size) of the signatures that several sets have and one of them probes."""
    if bins is not None:
        marked = F.broadcast(bins.withColumn("large", F.lit(True)))  # BINS rows at most
        sigs = sigs.withColumn("bin", F.pmod("sig", F.lit(BINS)).cast("int")).join(marked, "bin", "left").drop("bin").withColumn("large", F.coalesce("large", F.lit(False)))
    told = _told(sigs, bins is not None, low=F.min("cid"), high=F.max("cid"), probed=F.max("probe"), size=F.count("*"))
    return told.where("low < high and probed = 1").select("sig", "probe", "cid", "size")


def _indexed(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, scratch: Scratch):  # noqa: ANN202
    """What both joins start from: digests of rows, classes of equal sets, members of shared signatures, their classes with
    the smallest id and a weight, their sets, and whether there are large signatures."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = scratch.save(_digests(rows, words, percent))
    digest = scratch.save(signed.select("id", "n", "cid", "chk"))
    classes = scratch.save(digest.where("n > 0").groupBy("cid", "chk").agg(F.min("id").alias("rep")))
    sigs = [signed.select("cid", F.explode(f"sigs{k}").alias("x")).select(F.shiftrightunsigned("x", 1).alias("sig"), F.col("x").bitwiseAND(1).alias("probe"), "cid") for k in range(PASSES)]
    bins = _large(sigs, scratch)
    members = scratch.save(*[_shared(s, bins) for s in sigs])
    scratch.drop(signed)
    # The text that others were copied from shares most signatures with most texts; it makes the best centre.
    weight = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    some = scratch.save(weight.join(classes, "cid").where("rep is not null").select("cid", F.col("rep").alias("node"), "weight"))
    with bloom_joins(docs.sparkSession):
        wanted = rows.join(some.where("weight > 0"), F.col("id") == F.col("node")).select("cid", "text")
        sets = scratch.save(_sets(wanted, words))
    return digest, classes, members, some, sets, bins is not None


def _near(rows: DataFrame, sets: DataFrame, percent: int, also: str) -> DataFrame:
    """Pairs (a, b) of rows (sig, probe, cid, parts, ...) of a signature whose sizes and parities allow a link: these rule out
    most of what is near the threshold but below it before a pair is made. Each of the parts of a signature meets each other in a task."""
    told = rows.join(sets.select("cid", "n", "parity"), "cid")
    own, each = F.expr("cast(pmod(xxhash64(cid), parts) as int)"), F.explode(F.expr("sequence(0, parts - 1)"))
    x = told.withColumns({"i": own, "j": each}).alias("x")
    y = told.withColumns({"j": own, "i": each}).alias("y")
    apart_bits = " + ".join(f"bit_count(x.parity[{i}] ^ y.parity[{i}])" for i in range(16))
    near = f"x.sig = y.sig and x.i = y.i and x.j = y.j and {also} and x.probe + y.probe > 0 and {apart_bits} <= (x.n + y.n) * {100 - percent} / {100 + percent}"
    return x.join(y, F.expr(near)).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, n_shingles long, class_id, component_id).

    Two texts link when 100 * intersection >= percent * union of their sets of
    shingles of ``words`` words. A text of fewer words is one shingle; a text
    without words, or null, is empty and links with nothing. ``class_id`` is
    the smallest id with an equal set, ``component_id`` the smallest id that
    links reach, the own id included. Ids are integers; repeated rows stay and
    agree; rows with a null id get the ids of their class, if any. Other
    columns are not read. An empty table gives an empty table.

    Sets are named by 128 bits and shingles by 64; elements are compared by
    hash. Buckets and counts have no caps.
    """
    scratch = Scratch(ship(docs.sparkSession), tidy=True)
    digest, classes, members, some, sets, split = _indexed(docs, words, percent, id_col, text_col, scratch)
    apart = scratch.save(members.join(some, "cid").select("sig", "probe", "cid", "weight", F.col("node").alias("comp"), (F.col("size") > LARGE).alias("large")))
    scratch.drop(members)
    ends = some.select(F.col("cid").alias("a"), F.col("node").alias("na")), some.select(F.col("cid").alias("b"), F.col("node").alias("nb"))
    tried = links = label = None
    for turn in range(STARS + 1):
        if turn < STARS:
            centred = _told(apart, split, c=F.max(F.struct("weight", "cid", "comp")))
            pairs = centred.where("comp <> c.comp").select(F.least("cid", "c.cid").alias("a"), F.greatest("cid", "c.cid").alias("b"))
        else:
            pairs = _near(apart, sets, percent, "x.comp < y.comp")
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        more = scratch.save(_verified(pairs, sets, percent))
        links = more if links is None else links.union(more)
        if turn == 0 or more.limit(1).count():
            both = links.join(ends[0], "a").join(ends[1], "b")
            label = components(both.select(F.col("na").alias("a"), F.col("nb").alias("b")), scratch)
        if turn < STARS:
            placed = apart.join(some.select("cid", "node"), "cid").join(label, "node", "left")
            placed = placed.select("sig", "probe", "cid", "weight", F.coalesce("component", "node").alias("comp"), "large")
            placed = _told(placed, split, top=F.max(F.struct("weight", "cid")), low=F.min("comp"), high=F.max("comp"), left=F.count("*")).where("low < high")
            # A centre has met its bucket; it stands back, so that the next turn has another one.
            spent = F.when(F.col("cid") == F.col("top.cid"), -F.abs("weight")).otherwise(F.col("weight"))
            placed = placed.select("sig", "probe", "cid", spent.alias("weight"), "comp", "large", _parts(F.col("left")).alias("parts"))
            apart = scratch.save(placed)
            if not apart.limit(1).count():
                break
    found = classes.join(label, F.col("rep") == F.col("node"), "left").select("cid", "chk", "rep", F.coalesce("component", "rep").alias("component"))
    out = digest.select("id", "n", "cid", "chk").join(found, ["cid", "chk"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id")
    )


def ngram_links(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links themselves: (a, b), one row for each two classes of equal sets that link, named by their smallest ids, a < b.

    ``ngram_join`` tells the class of each row, so copies are not expanded into
    pairs. As many pairs are verified as share a signature: in a group of n
    near copies that differ, n * (n - 1) / 2. Rows with null ids count only as
    copies of others.
    """
    scratch = Scratch(ship(docs.sparkSession), tidy=True)
    _, _, members, some, sets, _ = _indexed(docs, words, percent, id_col, text_col, scratch)
    rows = members.join(some.select("cid"), "cid").select("sig", "probe", "cid", _parts(F.col("size")).alias("parts"))
    links = _verified(scratch.save(_near(rows, sets, percent, "x.cid < y.cid").distinct()), sets, percent)
    first, second = some.select(F.col("cid").alias("a"), F.col("node").alias("x")), some.select(F.col("cid").alias("b"), F.col("node").alias("y"))
    return links.join(first, "a").join(second, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those with a smaller id in their component.

    Rows with a null id stay. Of repeated rows (equal id and text) one stays.
    Columns are as before.
    """
    joined = ngram_join(docs, words, percent, id_col, text_col).where(f"component_id <> `{id_col}`").select(id_col)
    kept = docs.join(joined, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1").limit(1).count():  # only ids move to find this out
        return kept
    return kept.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, text_col]).union(kept.where(F.col(f"`{id_col}`").isNull()))


def op2(docs: DataFrame) -> DataFrame:
    return ngram_join(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 90 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
