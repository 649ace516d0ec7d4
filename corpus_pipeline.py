"""Documents to packed training sequences, in five stages.

Quality rules reject documents, line dedup cuts their texts, one document of
each near-duplicate group stays, documents that hold benchmark items go, and the
rest is packed. Each stage works on all that the one before it kept.

Null texts, languages and sources count as empty ones or as a group of their own, and
are kept where the rules keep them. Of equal documents the one with the smallest
doc_id stays (nulls last); rows that repeat in all of doc_id and text stay once. Further columns
come through all stages but the last unchanged, whatever their names. An empty table
gives no rows. What each stage does with very long texts stands in its module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm import decontaminate, lines, packing, quality, shingles
from cellsift.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = {c: f"{c}_of_input" for c in docs.columns if c == "removed_lines"}
    cut = lines.dedup_lines(docs.withColumnsRenamed(named))
    return cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).drop("removed_lines").withColumnsRenamed({v: k for k, v in named.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Components of similar texts and tokenizers can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
