"""The registered queries of the subpackage, each over its whole table, and the SQL that some can be held against."""

from __future__ import annotations

from . import bpe, chat, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, quality, secrets, sharding
from .common import table

QUERIES = {
    "op1_bpe": lambda spark, d: bpe.op1(table(spark, d, "documents")),
    "op2_ngram_join": lambda spark, d: ngram_join.op2(table(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: line_dedup.op3(table(spark, d, "documents")),
    "op4_secret_scan": lambda spark, d: secrets.op4(table(spark, d, "documents")),
    "op5_sharding": lambda spark, d: sharding.op5(table(spark, d, "documents")),
    "op6_chat_format": lambda spark, d: chat.op6(table(spark, d, "conversations")),
    "op7_decontaminate": lambda spark, d: decontaminate.op7(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_quality": lambda spark, d: quality.op8(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_language_id": lambda spark, d: language_id.op9(table(spark, d, "documents")),
    "op10_embedding_dedup": lambda spark, d: embedding_dedup.op10(table(spark, d, "embeddings")),
}

ORACLES = {"op2_ngram_join": ngram_join.ORACLE, "op6_chat_format": chat.ORACLE, "op10_embedding_dedup": embedding_dedup.ORACLE, "op3_line_dedup": line_dedup.ORACLE}
