"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Stages take documents (doc_id, text, lang, source, n_chars) and keep all of their columns, and any others, whatever
their names; only the last gives other ones. No rows give no rows. Very long texts are worked on as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, decontaminate, minhash, secrets, toxicity
from loomline.llm.text import positional
from loomline.session import discard, durable, scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts stay, unless so many labelled documents are
    toxic that any would go; repeated rows and rows without a doc_id go or stay by their text."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, and of several texts of one doc_id the
    one with the smallest hash; a row without a doc_id only if no other stands for it. Texts without words, null ones
    too, are no duplicates, but of rows with equal doc_id and text only one stays."""
    held, (own, text) = positional(docs, "doc_id", "text")
    counted = held.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(own).alias("ids")).first()
    if counted.n == counted.ids:
        kept = minhash.near_duplicates(docs).filter("kept").select("doc_id")
        return held.join(kept, F.col(own) == F.col("doc_id"), "left_semi").toDF(*docs.columns)
    once = held.dropDuplicates([own, text]).orderBy(F.col(own).asc_nulls_last(), F.xxhash64(text))
    rows = durable(once.withColumn("row", F.monotonically_increasing_id()), "rows")
    kept = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).filter("kept").select("doc_id")
    return rows.join(kept, F.col("row") == F.col("doc_id"), "left_semi").drop("row").toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; repeated rows and rows without a doc_id go or stay
    by their text; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars put right. A null text becomes an empty one of 0
    characters; each row gives a row."""
    masked = secrets.mask_secrets(docs)
    held, (text, n_chars) = positional(masked, "text", "n_chars")
    return held.withColumn(n_chars, F.char_length(text).cast(held.schema[n_chars].dataType)).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text: a row for each row. Null and empty texts have no ids."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a stage wrote goes when the next
    one is written; the last stage's own tables stay until its rows are read, at the latest to the application's end."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as kept:
            docs = durable(stage(spark, before, sf_dir), name)
            kept.append(docs)
        if hasattr(before, "durable_path"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and similarity graphs are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
