"""Benchmark decontamination by pigeonhole edit matching.

A test item of which a text may hold a copy with up to k edits is split into
k+1 pieces; one of them at least must then stand in the copy unchanged. All
pieces of all items are searched for at once by an automaton; each hit opens
a window that Myers' bit-parallel algorithm searches for the whole item within
k edits. Texts and items are compared with letters lower-cased and white
space collapsed. An item so short that no edit is allowed must stand alone:
between places that are not inside a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Scratch, without

#: Edits for each character of an item.
ERROR_RATE = 0.08
#: Bytes of items that the driver collects and broadcasts at most; a larger benchmark is matched in parts, one automaton at a time.
ITEM_BYTES = 16_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, most: int) -> bool:
    """Whether some substring of ``text`` is within ``most`` edits of ``pattern``."""
    m = len(pattern)
    if m <= most:
        return True
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= most:
            return True
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return False


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            s = normal(text)
            if not s:
                continue
            k = int(len(s) * rate)
            cuts = [len(s) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(s[a:b], []).append((len(self.items), a))
            self.items.append((item_id, s, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[int]:
        """Sorted ids of the items that the whole text holds."""
        if not self.items:
            return []
        s = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        alone: set[int] = set()
        for end, (length, where) in self.automaton.iter(s):
            first = end - length + 1
            # A hit between letters or digits is the inside of a word.
            inside = first > 0 and s[first - 1].isalnum() and s[first].isalnum() or end + 1 < len(s) and s[end].isalnum() and s[end + 1].isalnum()
            for no, offset in where:
                # A copy with this piece begins within k of the place that the piece implies, and ends within k of its end.
                item_id, item, k = self.items[no]
                if k == 0:
                    if not inside:
                        alone.add(item_id)
                    continue
                start = first - offset
                low, high = max(0, start - k), start + len(item) + k
                spans = windows.setdefault(no, [])
                if spans and low <= spans[-1][1]:  # overlapping windows are searched as one, so the work is linear in the text
                    spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
                else:
                    spans.append((low, high))
        return sorted(alone | {self.items[no][0] for no, spans in windows.items() if any(myers(self.items[no][1], s[a:b], self.items[no][2]) for a, b in spans)})


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` plus ``items`` array<long>: ids of the benchmark items that the text holds within
    ``rate`` edits a character, sorted; empty for clean, empty and null texts.

    An item of n normalised characters may differ by floor(n * rate) edits;
    where that is none it must stand alone, not inside a word. Items with a
    null id or a null or blank text say nothing and are left out; equal items
    are all named. Whole texts are searched. The benchmark is collected in
    parts of ``ITEM_BYTES``; between parts the rows are written to the shared
    folder, so a worker holds one automaton at a time. Columns called ``items``
    are replaced; repeated rows stay; empty tables are fine.
    """
    spark = ship(docs.sparkSession)
    docs = without(docs, "items")
    schema = docs.limit(0).withColumn("items", F.array(F.lit(0).cast("long"))).schema
    b = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null")
    total = b.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    parts = -(-total // ITEM_BYTES) or 1
    scratch = Scratch(spark)
    out = docs
    for part in range(parts):
        rows = (b if parts == 1 else b.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)).collect()  # about ITEM_BYTES
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=part == 0) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                got = [matcher.find(t.as_py() or "") for t in batch.column(text_col)]
                columns = list(batch.columns)
                if not first:
                    got = [sorted({*x, *y}) for x, y in zip(columns.pop().to_pylist(), got, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.list_(pa.int64()))], names=[f.name for f in schema])

        out = out.mapInArrow(run, schema)
        if part < parts - 1:
            out = scratch.save(out)
    return out


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with the benchmark items it holds."""
    out = find_leaks(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"))
