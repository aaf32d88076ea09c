"""The corpus pipeline: reject toxic and poor documents, drop boilerplate lines and near duplicates, pack what is left.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import lines, minhash, packing, rules, toxicity
from clickloom.llm.components import compact, release
from clickloom.llm.queries import quality_rules, ship_package, table, toxicity_chain
from clickloom.session import work_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the chain calls toxic go."""
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    name = lines.unused(docs, "rejected")
    return toxicity.with_rejection(docs, chain, "toxic", name=name).where(~F.col(name)).select(*docs.columns)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that fail the base rule or the learned list go."""
    return rules.only_kept(docs, quality_rules(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines on many sites stay only where they stand first; ``n_chars`` follows the text."""
    name = lines.unused(docs, "removed_lines")
    out = lines.deduplicate_lines(docs, count_col=name)
    return out.withColumn("n_chars", F.when(F.col(name) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, five-word shingles: of each group the document with the smallest id stays, once if its row is repeated."""
    ship_package(spark)
    found = compact(minhash.near_duplicates(docs))  # used twice: stored, so that it is worked out once
    told = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("stays"), F.count("*").alias("n")).where("n > 1 OR NOT stays")
    told = compact(told.select(F.col("doc_id").alias("id"), "stays"))
    # Ids that a bitmap tells from those are of one row each, which stays: only the other texts are shuffled.
    clear, caught = minhash.split_by_ids(docs, told, "doc_id")
    gone = told.where("NOT stays").select(F.col("id").alias("doc_id"))
    once = clear.unionByName(caught.dropDuplicates(["doc_id"]).join(gone.hint("merge"), "doc_id", "left_anti"))
    return once.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: where each piece of each document stands in the packed sequences."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_poor),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None
"""Trained models and packing have no SQL; the tests compare with plain versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
