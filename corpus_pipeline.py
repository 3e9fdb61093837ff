"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all that its predecessor kept and gives the columns of
documents back, except the last, which gives a row a piece with its sequence
and place.  Rows that share a doc_id, or have none, are separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.llm.core import docs_table, unused_name, written
from rankfield.llm.op1_pii import redact
from rankfield.llm.op3_quality_rules import accepted
from rankfield.llm.op5_decontamination import uncontaminated
from rankfield.llm.op9_best_fit_packing import best_fit_packing
from rankfield.llm.op10_simhash import simhash_components


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or a learned rule rejects."""
    return accepted(docs, docs_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints: the first row of the table, as numbered once and written."""
    row = unused_name("row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = simhash_components(numbered.select(F.col(row).alias("doc_id"), "text"))
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return uncontaminated(docs, docs_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets for each piece of personal data."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned rules, fingerprints, retrieval and packing have no SQL form.
ORACLE_SQL = None
