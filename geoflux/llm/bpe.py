"""Byte-level BPE by recursive DuckDB queries inside each partition.

A block of texts is cut where no pretoken can span, and each distinct piece of
it into pretokens by the tokenizer's pattern. Pretokens of pieces that the
worker does not know become rows (word, position, token), and one recursive
query contracts, for each word, the leftmost pair of least rank by a join with
the merge table, until no pair is left. Decoding joins ids with the vocabulary
and aggregates the bytes in order. A cache of two generations holds what was
found for pieces: what is asked for moves to the young one, so frequent pieces
are contracted and decoded once while memory stays bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..ship import ship
from .common import using, without

#: Entries in the young generation of a worker's cache; a full one takes the place of the old.
CACHE = 300_000
#: Text bytes in one block, bytes of words in one recursive query, and ids in one decoding query: they bound the worker's memory.
BLOCK_BYTES, QUERY_BYTES, QUERY_IDS = 6_000_000, 500_000, 1_000_000
#: Ids in one group of the ordered aggregation.
GROUP_IDS = 4096
#: Words above this many bytes go to the query that contracts many pairs at once.
LONG = 128
#: State rows that a recursive query over long words may gather before it is taken up anew.
STATE_ROWS = 2_000_000

SHORT_SQL = """
WITH RECURSIVE s(done, w, pos, upto, id, nid) AS (
  SELECT false, w, pos, upto, id, nid FROM base
  UNION ALL
  SELECT c.w IS NULL, s.w, CASE WHEN s.pos = c.mid THEN c.at ELSE s.pos END, s.upto,
         CASE WHEN s.pos = c.mid THEN c.rank ELSE s.id END,
         CASE WHEN s.upto = c.at THEN c.rank ELSE s.nid END
  FROM (SELECT * FROM s WHERE NOT done) s LEFT JOIN (
    SELECT w, (k >> 24)::INTEGER AS rank, (k >> 8 & 65535)::INTEGER AS at, ((k >> 8 & 65535) + (k & 255))::INTEGER AS mid
    FROM (SELECT s.w, min(m.k + (s.pos::BIGINT << 8)) AS k FROM s JOIN merges m ON s.id = m.a AND s.nid = m.b WHERE NOT s.done GROUP BY s.w)
  ) c ON s.w = c.w
  WHERE c.at IS NULL OR s.pos <> c.at
)
SELECT w, id FROM s WHERE done ORDER BY w, pos
"""

# All non-overlapping pairs of the least rank at once, from the left, up to the first whose
# contraction makes a neighbouring pair of lower rank: the one-by-one order would turn to that pair next.
LONG_SQL = """
WITH RECURSIVE s(step, w, pos, id) AS (
  SELECT 0, w, pos, id FROM state
  UNION ALL
  SELECT step + 1, w, pos, CASE WHEN chosen AND turn <= stop THEN rank ELSE id END
  FROM (
    SELECT *, lag(chosen AND turn <= stop, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, coalesce(min(turn) FILTER (chosen AND risky) OVER (PARTITION BY w), 2147483647) AS stop
      FROM (
        SELECT z.*, chosen AND (coalesce(ml.k >> 24, 99999999) < rank OR coalesce(mr.k >> 24, 99999999) < rank) AS risky,
               sum(chosen::INTEGER) OVER (PARTITION BY z.w ORDER BY z.pos ROWS UNBOUNDED PRECEDING) AS turn
        FROM (
          SELECT *, lag(chosen, 2, false) OVER (PARTITION BY w ORDER BY pos) AS after_chosen,
                 lag(id) OVER (PARTITION BY w ORDER BY pos) AS pid, lead(id, 2) OVER (PARTITION BY w ORDER BY pos) AS nnid
          FROM (
            SELECT *, least_one AND (row_number() OVER (PARTITION BY w, least_one, run ORDER BY pos)) % 2 = 1 AS chosen
            FROM (
              SELECT *, n - row_number() OVER (PARTITION BY w, least_one ORDER BY pos) AS run
              FROM (
                SELECT *, coalesce(own = rank, false) AS least_one FROM (
                  SELECT p.*, m.k >> 24 AS own, min(m.k >> 24) OVER (PARTITION BY p.w) AS rank
                  FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) AS n, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nid FROM s WHERE step < {steps}) p
                  LEFT JOIN merges m ON p.id = m.a AND p.nid = m.b
                ) WHERE rank IS NOT NULL
              )
            )
          )
        ) z
        LEFT JOIN merges ml ON ml.a = CASE WHEN after_chosen THEN z.rank ELSE z.pid END AND ml.b = z.rank
        LEFT JOIN merges mr ON mr.a = z.rank AND mr.b = z.nnid
      )
    )
  ) WHERE NOT gone
)
SELECT s.w, s.pos, s.id, s.step FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) l ON s.w = l.w AND s.step = l.step ORDER BY s.w, s.pos
"""

DECODE_SQL = "SELECT r.w, string_agg(v.piece, '' ORDER BY r.pos) AS piece FROM runs r JOIN vocabulary v ON r.id = v.id GROUP BY r.w ORDER BY r.w"


# Classes of bytes: ASCII white space; letters and digits; other graphic characters but the apostrophe; bytes that begin no white space.
_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_GRAPHIC = (_BYTE > 32) & (_BYTE < 127)
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_POINT = _GRAPHIC & ~_ALNUM & (_BYTE != 39)
_BEGINS = _GRAPHIC | (_BYTE >= 0xC3) & ~np.isin(_BYTE, [0xE1, 0xE2, 0xE3])


def _ends_in_space(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the character of several bytes that ends before each place is white space of Unicode."""
    a, b, c = x[p - 1], x[p - 2], x[p - 3]
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    return two | general | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE2) & (b == 0x81) & (a == 0x9F) | (c == 0xE3) & (b == 0x80) & (a == 0x80)


def cut(x: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """Of texts in UTF-8 between bounds: the distinct pieces, the pieces in order by their numbers, and the bounds in pieces.

    A pretoken is white space, or a space at most and then only letters, only digits or only other characters (or an
    apostrophe and letters). So none spans a place where white space follows another character, or a sign other than
    the apostrophe a letter or digit; nor the place after a single line feed.
    """
    space = _SPACE[x]
    at = np.flatnonzero(space[1:]) + 1
    before = x[at - 1]
    sure = _GRAPHIC[before]
    high = np.flatnonzero(before >= 128)
    high = high[at[high] > 2]  # a character of two bytes at the very start stays with what follows
    sure[high] = ~_ends_in_space(x, at[high])
    at = at[sure]
    feed = at[x[at] == 10] + 1
    feed = feed[feed < len(x)]
    mark = np.zeros(len(x) + 1, bool)
    mark[1:-1] = _POINT[x[1:]] & _ALNUM[x[:-1]]
    mark[at] = mark[feed[_BEGINS[x[feed]]]] = mark[bounds] = True
    places = np.flatnonzero(mark).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(x)]).dictionary_encode()
    return _parts(pieces.dictionary), pieces.indices, np.searchsorted(places, bounds)


def _parts(binary: pa.Array) -> list[bytes]:
    ends = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1].tolist()
    raw = (binary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


#: Of a piece: its ids as packed little-endian int32, each id in decimal and a space, and the bytes that the ids decode to.
Coded = tuple[bytes, bytes, bytes]


class Codec:
    """Encoder and decoder of one vocabulary, with its tables in an in-memory DuckDB of the worker."""

    def __init__(self, vocabulary: str, pattern: str):
        import duckdb
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(_path(vocabulary), "rb") if line.strip())}
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        a, b, k, adjacent = [], [], [], np.zeros(65536, bool)
        for token, rank in ranks.items():
            raw = np.frombuffer(token, np.uint8).astype(np.int32)
            adjacent[raw[:-1] * 256 + raw[1:]] = True
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), k.append(rank << 24 | min(i, 255))
        self.adjacent = adjacent  # of two bytes: some token holds them side by side
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET enable_progress_bar = false")
        for name, columns in (
            ("merges", {"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "k": pa.array(k, pa.int64())}),
            # Each byte stands as the character 256 above it, so that pieces are text to the aggregation.
            ("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "piece": ["".join(chr(256 + x) for x in t) for t in ranks]}),
        ):
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.names = [b"%d " % i for i in range(max(ranks.values()) + 1)]
        self.young: dict[bytes, Coded] = {}
        self.old: dict[bytes, Coded] = {}

    # ---- encoding

    def coded(self, pieces: list[bytes]) -> list[Coded]:
        """What is known of each piece, or now learned."""
        out = list(map(self.young.get, pieces))
        unknown = []
        for i in [i for i, v in enumerate(out) if v is None]:
            v = out[i] = self.old.get(pieces[i])
            if v is None:
                unknown.append(i)
            else:
                self._put(pieces[i], v)
        new = [pieces[i] for i in unknown]
        for i, piece, v in zip(unknown, new, self._code(new), strict=True):
            out[i] = v
            if len(piece) <= LONG:
                self._put(piece, v)
        return out

    def _put(self, piece: bytes, value: Coded) -> None:
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = value

    def _code(self, pieces: list[bytes]) -> Iterator[Coded]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        # A piece of ASCII letters, after a space at most, is one pretoken.
        found = [(t,) if t.isascii() and (t.isalpha() or t[:1] == " " and t[1:].isalpha()) else self.find(t) for t in texts]
        known: dict[str, bytes] = {}
        self._learn(list({w for parts in found for w in parts}), known)
        packed = [known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts)) for parts in found]
        names = list(map(self.names.__getitem__, np.frombuffer(b"".join(packed), "<i4").tolist()))
        start = 0
        for piece, ids, back in zip(pieces, packed, self.decode(packed), strict=True):
            end = start + len(ids) // 4
            yield ids, b"".join(names[start:end]), piece if back == piece else back  # equal bytes are held once
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian int32."""
        out = []
        for _, _, x, bounds in blocks(pa.array(texts, pa.large_string())):
            pieces, order, ends = cut(x, bounds)
            out += joined([v[0] for v in self.coded(pieces)], order, ends)
        return out

    def _learn(self, words: list[str], known: dict[str, bytes]) -> None:
        """Adds the ids of words to ``known``."""
        block, size = [], 0
        for w in words:
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                known[w] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                known[w] = self._long(raw)
            else:
                block.append((w, raw))
                size += len(raw)
                if size > QUERY_BYTES:
                    self._query(block, known)
                    block, size = [], 0
        if block:
            self._query(block, known)

    def _query(self, block: list[tuple[str, bytes]], known: dict[str, bytes]) -> None:
        lengths = np.array([len(raw) for _, raw in block])
        ids = self.bytes[np.frombuffer(b"".join(raw for _, raw in block), np.uint8)]
        w = np.repeat(np.arange(len(block), dtype=np.int32), lengths)
        ends = np.cumsum(lengths)
        pos = (np.arange(len(ids)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        nid = np.append(ids[1:], -1).astype(np.int32)
        nid[ends - 1] = -1
        self.db.register("base", pa.table({"w": w, "pos": pos, "upto": pos + 1, "id": ids, "nid": nid}))
        out = self.db.execute(SHORT_SQL).fetchnumpy()
        self.db.unregister("base")
        flat = np.ascontiguousarray(out["id"], "<i4")
        at = np.searchsorted(out["w"], np.arange(len(block) + 1))
        for i, (word, _) in enumerate(block):
            known[word] = flat[at[i] : at[i + 1]].tobytes()

    def _long(self, raw: bytes) -> bytes:
        """A long word: cut where no token holds the two bytes, then contracted in rounds of bounded size."""
        x = np.frombuffer(raw, np.uint8).astype(np.int32)
        part = np.concatenate([[0], np.cumsum(~self.adjacent[x[:-1] * 256 + x[1:]])]).astype(np.int32)
        state = pa.table({"w": part, "pos": np.arange(len(x), dtype=np.int32), "id": self.bytes[x]})
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(state):
            steps = max(1, STATE_ROWS // len(state))
            self.db.register("state", state)
            out = self.db.execute(LONG_SQL.format(steps=steps)).fetchnumpy()
            self.db.unregister("state")
            more = out["step"] == steps  # a word that stopped earlier has no pair left
            done.append((out["pos"][~more], out["id"][~more]))
            state = pa.table({k: np.ascontiguousarray(out[k][more], np.int32) for k in ("w", "pos", "id")})
        pos, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        return np.ascontiguousarray(ids[np.argsort(pos, kind="stable")], "<i4").tobytes()

    # ---- decoding

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each packed array of ids: a join with the vocabulary and an ordered aggregation."""
        out: list[bytes] = []
        start, size = 0, 0
        for end, ids in enumerate(packed, 1):
            size += len(ids) // 4
            if size > QUERY_IDS or end == len(packed):
                out += self._decode(packed[start:end])
                start, size = end, 0
        return out

    def _decode(self, packed: list[bytes]) -> list[bytes]:
        """Neighbouring runs are aggregated together, for a group of its own costs more than a run, and cut by the lengths of their tokens."""
        ids = np.frombuffer(b"".join(packed), "<i4")
        ends = np.cumsum([len(p) // 4 for p in packed])
        upto = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], ends])]
        pos = np.arange(len(ids), dtype=np.int32)
        self.db.register("runs", pa.table({"w": pos // GROUP_IDS, "pos": pos, "id": ids}))
        got = self.db.sql(DECODE_SQL).to_arrow_table()
        self.db.unregister("runs")
        raw = b"".join(x.encode("utf-16-le")[::2] for x in got["piece"].to_pylist())
        return [raw[a:b] for a, b in zip(upto.tolist(), upto[1:].tolist(), strict=False)]


_codecs: dict[tuple[str, str], Codec] = {}


def _path(vocabulary: str) -> str:
    """A path as it is; a bare name is a file of the installed vocabularies."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def codec(vocabulary: str, pattern: str | None = None) -> Codec:
    """The worker's codec of a vocabulary, made once."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    using("bpe", _codecs.clear)
    key = (vocabulary, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of whole texts, about BLOCK_BYTES each or a single text; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    x = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_BYTES, "right")) - 1)
        yield start, end, x[ends[start] : ends[end]], ends[start : end + 1] - ends[start]
        start = end


def joined(parts: Sequence[bytes], order: pa.Array, ends: np.ndarray) -> list[memoryview]:
    """The parts of each text put together in their order."""
    every = pa.array(parts, pa.large_binary()).take(order)
    at = np.frombuffer(every.buffers()[1], np.int64)[ends + every.offset].tolist()
    raw = memoryview(every.buffers()[2] or b"")
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


VOCABULARY = "byte_bpe_50k.tiktoken"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows of ``docs`` plus ``ids`` array<int>: the ordinary tokens of the whole text.

    Null and empty texts have an empty array. No special tokens. Repeated rows
    stay; a column called like ``ids_col`` is replaced; an empty table stays
    empty. Any column passes through, whatever its name.
    """
    ship(docs.sparkSession)
    docs = without(docs, ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for a, b, x, bounds in blocks(batch.column(text_col)):
                pieces, order, ends = cut(x, bounds)
                packed = joined([v[0] for v in c.coded(pieces)], order, ends)
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """The rows plus ``bytes`` binary: the decoded ids (null ids: null). Ids outside the vocabulary fail."""
    ship(rows.sparkSession)
    rows = without(rows, bytes_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                packed = [None if x.as_py() is None else np.asarray(x.as_py(), "<i4").tobytes() for x in part.column(ids_col)]
                got = iter(c.decode([p for p in packed if p is not None]))
                out = pa.array([None if p is None else next(got) for p in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, bytes_col])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and then decoding each whole text, in one pass: what ``encode`` and ``decode`` give, without moving the ids.

    Null and empty texts have no tokens; repeated rows and null ids stay; other columns are not read."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for a, b, x, bounds in blocks(batch.column(1)):
                pieces, order, ends = cut(x, bounds)
                packed, decimal, got = (joined(part, order, ends) for part in (zip(*c.coded(pieces), strict=True) if pieces else ((),) * 3))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([sha(d[:-1]) for d in decimal]),
                        pa.array(list(map(sha, got))),
                    ],
                    names=[f.name for f in schema],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
