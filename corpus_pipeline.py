"""A training corpus from raw documents, in five stages: quality rules, near-duplicates, benchmark decontamination,
pseudonyms, packing. Each stage takes what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm import decontaminate, near_dup, packing, pii, quality
from palate.llm.common import materialise
from palate.llm.queries import WORD_TOKENIZER, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the floor or the list learned from the labels rejects go."""
    rules = quality.learn(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.judge(docs, rules).where("__kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id. Equal rows stay once."""
    gone = near_dup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone"))
    # of rows that repeat an id, the operator has judged the smallest text; others stay, equal rows once
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if twice.isEmpty():
        return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    single = docs.join(twice, docs["doc_id"] == F.col("__twice"), "left_anti")
    single = single.join(gone, single["doc_id"] == F.col("__gone"), "left_anti")
    again = docs.join(twice, docs["doc_id"] == F.col("__twice"), "left_semi")
    row = F.min(F.struct(F.col("text").isNull().alias("none"), "text", F.struct(*docs.columns).alias("row")))
    again = again.groupBy("doc_id", "text").agg(row.alias("r")).select("r.row.*", "r.none")
    judged = again.groupBy("doc_id").agg(F.min(F.struct("none", "text")).alias("j")).join(gone, F.col("doc_id") == F.col("__gone"))
    bad = judged.select("__gone", F.col("j.text").alias("__text"))
    left = again.join(bad, (again["doc_id"] == F.col("__gone")) & again["text"].eqNullSafe(F.col("__text")), "left_anti")
    return single.unionByName(left.drop("none"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of their format; n_chars follows the text."""
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("best-fit packing", best_fit_packing),
]

#: The learned verdicts and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
