"""From raw documents to token ids: five stages, each on all that the one before kept.

1. quality: documents that the classifier rejects go.
2. lines: lines that many documents repeat go from all but one.
3. near_duplicates: one document (the smallest id) of each group stays;
   shingles of five words, Jaccard similarity of 0.8 or more.
4. decontaminate: documents that hold a benchmark item go.
5. tokens: byte-level BPE of what is left, and back; the last stage returns
   digests, all others the columns of ``documents`` (``n_chars`` follows the text).

Every stage takes any rows: null ids and columns, null, empty and very long
texts, repeated rows, tables without rows, and further columns whatever their
names, which it drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflux.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from geoflux.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier keeps. Null, empty and blank texts go; equal rows fare alike."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), columns=list(COLUMNS)).where("kept").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their texts without common lines. A null text becomes empty; rows with a null id stay as they are."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group, and one of repeated rows. Texts without words are in no group; rows with a null id stay."""
    return ngram_join.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts hold no benchmark item. Null and empty texts hold none."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row the id, the number of tokens, and digests of the ids and of what they decode to. Null texts count as empty."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", by_quality),
    ("lines", without_common_lines),
    ("near_duplicates", one_of_each_group),
    ("decontaminate", clean_of_benchmarks),
    ("tokens", tokens),
]

#: SQL cannot express the classifier, the edit matching and the merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
