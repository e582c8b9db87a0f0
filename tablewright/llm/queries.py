"""The opN_ queries over the driver's tables, thin over the operators beside them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lines, mixing, quality, rules, simhash, topk, toxicity, urls
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    return chat.digest(chat.format_chats(turns))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents")).select("doc_id", "votes", "score", "kept")


def tokenizer_path() -> str:
    """The file that the driver's contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    scores = toxicity.score(docs, toxicity.fit(docs, labels))
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), spread=lines.SPREAD, long=lines.LONG).select("doc_id", "line_count", "removed_lines", "text")


#: Query and SQL; None where SQL cannot express the operator.
ALL = {
    "op1_mixing": (op1_mixing, mixing.ORACLE_SQL),
    "op2_quality_rules": (op2_quality_rules, rules.ORACLE_SQL),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_simhash": (op4_simhash, None),
    "op5_topk": (op5_topk, topk.ORACLE_SQL),
    "op6_bpe": (op6_bpe, None),
    "op7_chat_format": (op7_chat_format, chat.ORACLE_SQL),
    "op8_url_filter": (op8_url_filter, urls.ORACLE_SQL),
    "op9_toxicity": (op9_toxicity, None),
    "op10_line_dedup": (op10_line_dedup, lines.ORACLE_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
