"""The corpus operators as queries over the driver's tables, with production parameters.

Each callable takes (spark, sf_dir) and applies one operator to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import embedding_dedup, license_scan, mixing, near_dup, ngram_rules, oracles, packing, quality_classifier, substring_dedup, token_files, url_filter
from codeloom.llm.common import Scratch, own_batches, small_batches, small_reads, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    path = scratch.place()
    with own_batches(spark), small_reads(spark):
        small_batches(spark)
        token_files.write_token_files(spark, table(spark, sf_dir, "documents"), path, scratch)
    return token_files.read_token_files(spark, path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    with own_batches(spark), small_reads(spark):
        small_batches(spark)
        sizes = scratch.keep(token_files.tokenize(table(spark, sf_dir, "documents"), token_files.default_tokenizer(), keep_ids=False))
    return packing.pack_documents(sizes)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(spark, docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(spark, docs, model)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings"), Scratch(spark, "op4"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "pass", "position", "n_tokens", "weight")


def op6_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return ngram_rules.judge(spark, table(spark, sf_dir, "documents"), trusted, Scratch(spark, "op6"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "dedup.text", "dedup.n_sentences", "dedup.n_removed")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similarity_join(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op9")).drop("text_key")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


OPERATORS = (
    op1_token_files,
    op2_packing,
    op3_quality_classifier,
    op4_embedding_dedup,
    op5_mixing,
    op6_ngram_rules,
    op7_substring_dedup,
    op8_license_scan,
    op9_jaccard_join,
    op10_url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
