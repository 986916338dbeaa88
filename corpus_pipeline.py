"""Documents to training order: quality rules, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, extra ones too.

Nulls: texts without words fail the quality rules; null ids, langs and sources are carried. Rows are known by id and text: of
rows equal in both one stays, and of a group of near duplicates the one with the least id (nulls last), ties by the text's
hash, so reruns agree. Very long texts are worked on whole. An empty table gives empty results. Extra columns are carried to the
end; the last stage drops those named as its results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlake.llm import common, curriculum_mix, decontaminate, near_dup, quality_rules, secret_scan


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    kept = quality_rules.clean_lines(common.packed(docs, text=F.col("text"))).where("kept")
    fresh = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more; rows are known by id (null or not) and text, one of each stays."""
    kept = near_dup.near_duplicates(docs.select("doc_id", "text"), by_text=True).where("kept").select("doc_id", "key").distinct().alias("k")
    rows = common.packed(docs, doc_id=F.col("doc_id"), key=F.xxhash64("text")).alias("d")
    rows = rows.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.key") == F.col("k.key")), "left_semi")
    return rows.dropDuplicates(["doc_id", "key"]).select("row.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    found = secret_scan.scan_secrets(docs, replace=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in training order: one row for each copy (from 0), with its position and the number of copies; taken is of all copies."""
    return curriculum_mix.training_order(docs, keep=tuple(docs.columns)).drop("source_size", "target")


STAGES = [("quality_rules", quality_stage), ("near_dup", near_dup_stage), ("decontaminate", decontaminate_stage), ("secret_scan", secret_stage), ("curriculum_mix", mix_stage)]

#: Near duplicates and SimHash windows have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What earlier stages wrote is deleted as soon as the next has its output; the last of it stays, since the result reads it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
