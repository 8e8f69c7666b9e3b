"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from texts known
to be in it. A text goes to the language whose dictionary compresses it best;
a narrow margin to the second best is marked as a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship

#: Bounds of the fit: texts and bytes for each language.
TEXTS, DICTIONARY_BYTES = 64, 65_536
#: Characters of the texts that the fit prefers.
USUAL = (200, 20_000)
#: Texts are compressed in pieces of this many bytes, so that the dictionary counts alike in long and short texts.
PIECE = 2048
#: Relative margins below this are rejected.
MARGIN = 0.01
NONE = "und"
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-cased letters; whatever lies between words is one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language from labelled rows: the ``TEXTS`` rows of least hash in each language, up to
    ``DICTIONARY_BYTES`` in all, normalised. Texts whose length is in ``USUAL`` come first, then all others,
    so every language has a dictionary. Rows with a null text or language, or without a letter, are not used; the
    result is bounded by the number of languages."""
    rank = Window.partitionBy("lang").orderBy("odd", "h", "id")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    base = base.where("lang is not null and text is not null and id is not null")
    # Ids are ranked without their texts; Spark keeps only the first rows of each task before the exchange.
    chosen = base.where(F.col("text").rlike(r"\p{L}")).select("id", "lang", (~F.length("text").between(*USUAL)).alias("odd"), F.xxhash64("id").alias("h")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= TEXTS)
    # Of a long text the driver needs as much as fills a dictionary, once what is no letter is taken together.
    start = F.left(F.regexp_replace("text", r"[\p{Z}\p{C}\p{P}\p{S}\p{Nd}]+", " "), F.lit(DICTIONARY_BYTES))
    text = F.when(F.length("text") > USUAL[1], start).otherwise(F.col("text")).alias("text")
    rows = base.join(F.broadcast(chosen.select("id", "r")), "id").select("lang", "r", text).collect()  # TEXTS a language at most
    out: dict[str, bytes] = {}
    for lang in sorted({r.lang for r in rows}):
        each = [normal(r.text) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.r)]
        share = DICTIONARY_BYTES // len(each) + 1
        while sum(min(len(e), share) for e in each) < DICTIONARY_BYTES and share < max(map(len, each)):
            share *= 2
        out[lang] = b" ".join(e[:share] for e in each)[:DICTIONARY_BYTES]
    return out


def sizes(text: str, compressors: list) -> list[int]:
    """Compressed bytes of the whole text by each compressor, in pieces."""
    raw = normal(text)
    return [sum(len(c.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for c in compressors]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` plus lang_pred, score and lang_accepted.

    ``lang_pred`` is the language of least compressed size (first by name when
    equal); ``und`` with score 0 if the text is null or has no letter, or if no
    language was learned. ``score`` is 1 - least / second (1 with a single
    language), between 0 and 1; ``lang_accepted`` is whether it reaches
    ``MARGIN``. Whole texts are used. Repeated rows get equal results. Columns
    of these names are replaced; an empty table stays empty.
    """
    from .common import without

    ship(docs.sparkSession)
    docs = without(docs, "lang_pred", "score", "lang_accepted")
    names, raws = list(dictionaries), list(dictionaries.values())
    schema = docs.limit(0).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "lang_accepted": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        made = []
        for raw in raws:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            # Short matches tell languages apart; the fast strategies of low levels miss them.
            how = zstd.ZstdCompressionParameters.from_level(
                5, dict_size=len(raw), source_size=PIECE, strategy=zstd.STRATEGY_GREEDY, min_match=4, search_log=4, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            d.precompute_compress(compression_params=how)
            made.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))
        for batch in batches:
            pred, score = [], []
            for t in batch.column(text_col):
                t = t.as_py()
                if not t or not names or not any(map(str.isalpha, t)):
                    pred.append(NONE), score.append(0.0)
                    continue
                order = sorted(zip(sizes(t, made), names, strict=True))
                pred.append(order[0][1])
                score.append(1 - order[0][0] / order[1][0] if len(order) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array([s >= MARGIN for s in score], pa.bool_())], names=[f.name for f in schema]
            )

    return docs.mapInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    known = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), known).select("doc_id", "held_out", "lang_pred", "score", "lang_accepted")
