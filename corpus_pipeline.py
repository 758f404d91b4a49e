"""Corpus pipeline: quality, near duplicates, benchmark overlaps, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. A stage works on
all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptloom.llm import decontaminate, mixing, nearcopies, pii, quality
from promptloom.llm._common import remove, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold.

    Null and empty texts are scored like others; rows that repeat, null doc_ids and any columns pass through; without labels all rows
    have the same score; an empty table stays empty.
    """
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, score="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, Jaccard similarity of at least 0.8.

    The smallest doc_id stays, a null one only if there is no other; null, empty and blank texts are one group; rows that repeat leave
    one; columns are unchanged; an empty table stays empty.
    """
    return nearcopies.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts overlap none; rows that repeat go or stay together; with an empty benchmark all stay; columns are unchanged.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows where there is such a column.

    A null text stays null; rows that repeat stay repeated; columns and their order are unchanged; an empty table stays empty.
    """
    clean = pii.find_spans(docs, pii.train(), redacted="__redacted").withColumn("text", F.col("__redacted")).drop("__redacted")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix.

    A null source is a source of its own; null doc_ids and texts take part; rows that repeat get different places; columns named like
    the new ones are replaced; an empty table stays empty.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: Stages are trained models, fingerprints and a scheduler; the tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read is removed when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
