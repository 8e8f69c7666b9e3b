"""Line dedup, in DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits; the documents of each
hash are counted with map-side combine (a line that a third of the corpus
holds is one row per task); lines over the threshold go from every document
but the one with the largest id; texts are reassembled by position. Where the
lines of a key meet its verdict, a key is cut by hashes of its documents into
``SALTS`` parts, and the verdict goes to the parts that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, ascii_lower, without

SALTS = 32


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    # lower() is far cheaper than translate() and the same on pure ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` with ``text`` reassembled, plus ``n_lines`` and ``n_dropped``.

    A line goes if its key has at least ``min_chars`` code points and at least
    ``min_docs`` documents hold the key, except in the document with the
    largest ``doc_id`` among them, which keeps all its copies.

    Null or empty text is one empty line and comes back as an empty text. Rows
    with a null ``doc_id`` are neither counted nor changed. Repeated rows
    (equal id) count as one document and are treated alike. An empty table
    gives an empty table. Columns called ``n_lines`` or ``n_dropped`` are
    replaced; all others pass through whatever their names.
    """
    docs = without(docs, "n_lines", "n_dropped")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    # Two hashes make the identity of a row, so that repeated ids with other texts do not mix.
    ident = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("h"), lines.alias("lines"))
    long = F.char_length(F.btrim("line", F.lit(SPACE))) >= min_chars
    key = F.unhex(F.md5(line_key(F.col("line")).cast("binary")))
    each = (
        ident.select("doc_id", "h", F.posexplode("lines").alias("pos", "line"))
        .where(long)
        .select("doc_id", "h", "pos", key.alias("key"))
    )
    each = Scratch(docs.sparkSession).save(each)  # both uses below read it, so texts are normalised once
    # A document's lines are in one task, so the first aggregation leaves one row a document and key before its exchange.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    part = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SALTS}) as int))")).alias("parts")
    held = each.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"), part)
    over = held.where(F.col("n") >= min_docs).select("key", "keeper", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(parts, i) = 1)")).alias("salt"))
    drops = each.withColumn("salt", salt).join(over, ["key", "salt"]).where("doc_id <> keeper").groupBy("doc_id", "h").agg(F.collect_set("pos").alias("drop"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(text).alias("h"))
    out = rows.join(drops, ["doc_id", "h"], "left")
    of_row = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)
    # array_except of integers is a hash lookup in order, so reassembly is linear in the lines.
    kept = F.expr("array_except(sequence(0, size(lines) - 1), drop)")
    built = F.when(F.col("drop").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
    )
    out = out.select("row", "drop", of_row.alias("lines"))
    return out.select(
        *[(built if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
    )


def op3(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.*, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
