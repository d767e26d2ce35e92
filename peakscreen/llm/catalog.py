"""Registered queries of the training-data operators and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakscreen.llm import (
    centroids,
    chat_format,
    collocations,
    decontam,
    embedding_pq,
    line_dedup,
    mil_quality,
    mixing,
    quality_rules,
    sharding,
    simhash_dedup,
    token_store,
    toxicity,
)
from peakscreen.llm.common import shared_path, table
from peakscreen.session import ensure_checkpoint_dir


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer's vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return line_dedup.line_table(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings; formatted with the others.
CONTROL_CASE = (-1, "</s>[INST] ok [/INST]")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    conv, text = CONTROL_CASE
    extra = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    vocabulary = tokenizer_file("byte_bpe_50k.json")
    return chat_format.read_back(chat_format.format_conversations(turns, vocabulary), vocabulary)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return simhash_dedup.dedup_table(table(spark, sf_dir, "documents"))


def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return mil_quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "token-store")
    # The ids are those of the tokenizers library as it is: control strings in a text get their special ids.
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), control_ids=True)
    return token_store.read_documents(spark, path)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return decontam.decontam_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return collocations.collocation_table(table(spark, sf_dir, "documents"))


def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return centroids.cluster_table(table(spark, sf_dir, "embeddings"))


def op13_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return embedding_pq.dedup_table(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_simhash": op5_simhash,
    "op6_mil_quality": op6_mil_quality,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_store": op8_token_store,
    "op9_winnowing": op9_winnowing,
    "op10_hash_tree": op10_hash_tree,
    "op11_collocations": op11_collocations,
    "op12_shallot": op12_shallot,
    "op13_product_quantisation": op13_product_quantisation,
}

SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.QUALITY_SQL,
    "op7_mix_sources": mixing.MIX_SQL,
    "op9_winnowing": decontam.DECONTAM_SQL,
    "op11_collocations": collocations.COLLOCATION_SQL,
    "op12_shallot": centroids.CLUSTER_SQL,
    "op13_product_quantisation": embedding_pq.NEAR_SQL,
}
