"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

All but the last return the columns of ``documents``:

1. quality_classifier: documents that the co-trained classifier rejects go;
2. jaccard_join: one document of each group of near copies stays, of equal rows one;
3. substring_dedup: sentences of repeated passages go, and documents of which no word is left;
4. mixing: sources are repeated towards their target weights (repeated documents are repeated rows);
5. packing: the bins of a training sequence file, one row for each piece of a document.

Rows are named by doc_id and text together, so of rows that share a doc_id each is judged by its own text.
Edge cases: null texts are judged by the classifier as empty, have no copies, no sentences, count as one
token and are packed as their end id; a null doc_id has no copies and stays; texts of any length are used
whole; ties go to the least doc_id, then the least hash of the text; an empty table gives an empty result
with the columns of each stage; columns beyond those of ``documents`` pass through, whatever their names.

A stage's result is lazy and reads scratch tables.  ``run`` writes each stage's result and then frees that
stage's scratch, and no one else's.  Stages set small Arrow batches for the session, as rows carry whole
texts; ``run`` puts the session's own size back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import mixing, near_dup, packing, quality_classifier, substring_dedup, token_files
from codeloom.llm.common import SPACES, Scratch, join_keys, own_batches, scratch_of_block, small_batches, table

#: The stages are no SQL: a trained classifier, hashing and packing decide.  Tests hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality_classifier.train(spark, docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep(spark, docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark, "pipeline2")
    judged = scratch.keep(near_dup.similarity_join(spark, docs, scratch).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), "kept"))
    text = F.xxhash64(F.col("text").cast("string")).alias("__text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("__id"), text)
    named = judged.where("kept and __id is not null").groupBy("__id", "__text").agg(F.count("*").alias("n"))
    twice = scratch.keep(named.where("n > 1").select("__id", "__text"))
    gone = scratch.keep(judged.where("not kept").select("__id", "__text").distinct())
    rows = join_keys(rows, gone, ["__id", "__text"], "left_anti")
    if twice.head(1):
        once = join_keys(rows, twice, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"])
        rows = join_keys(rows, twice, ["__id", "__text"], "left_anti").unionByName(once)
    return rows.select("row.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = substring_dedup.dedup(spark, docs, Scratch(spark, "pipeline3"))
    emptied = (F.col("dedup.n_removed") > 0) & (F.length(F.translate("dedup.text", SPACES, "")) == 0)
    kind = dict(docs.dtypes)["text"]
    columns = [F.col("dedup.text").cast(kind).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(spark, docs, Scratch(spark, "pipeline4")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    sizes = token_files.tokenize(docs, token_files.default_tokenizer(), keep_ids=False, words_kept=0)
    return packing.pack_documents(Scratch(spark, "pipeline5").keep(sizes))


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written in the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    with own_batches(spark):
        for _, stage in STAGES[:-1]:
            with scratch_of_block():
                docs = scratch.keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
