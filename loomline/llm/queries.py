"""The named query of each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, chat, decontaminate, minhash, private, quality, repeats, secrets, shards, toxicity
from loomline.llm.oracles import ORACLES  # noqa: F401
from loomline.session import table


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.sql("select -1L conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]') as (turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return chat.read_back(chat.windows(turns))


def op4_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_report(table(spark, sf_dir, "documents"))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(table(spark, sf_dir, "documents"), private.key_of(spark))


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_duplicates, op2_byte_bpe, op3_chat_windows, op4_histogram_sort_shards, op5_randomness_secrets, op6_host_quality,
            op7_suffix_repeats, op8_feistel_pseudonyms, op9_ftrl_toxicity, op10_qgram_decontamination,
    )
}
