"""Workloads and calibration pairs from row numbers and hashes: the same on every run, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOPICS = ["refunds", "shipping", "passwords", "billing", "accounts", "returns", "warranty", "delivery"]
TURNS = {"rag": (3, 3), "agent": (4, 8), "chat": (10, 13), "faq": (1, 1)}


def pick(items: list[str], *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(*keys), F.lit(len(items))) + 1).cast("int"))


def workload(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """(sample_id, workload, turn, role, text): ``n`` conversations with the kind's number of turns."""
    low, high = TURNS[kind]
    rows = spark.range(n).withColumn("turns", low + F.pmod(F.xxhash64("id", F.lit(kind)), F.lit(high - low + 1)))
    turns = rows.select(F.concat(F.lit(f"{kind}-"), "id").alias("sample_id"), F.explode(F.sequence(F.lit(0), (F.col("turns") - 1).cast("int"))).alias("turn"))
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    topic = pick(TOPICS, F.col("sample_id"))
    text = F.when(role == "user", F.concat(F.lit("Tell me about "), topic, F.lit(" step "), F.col("turn"))).otherwise(F.concat(F.lit("Step "), F.col("turn"), F.lit(" of "), topic, F.lit(" is simple.")))
    return turns.select("sample_id", F.lit(kind).alias("workload"), "turn", role.alias("role"), text.alias("text"))


def faq(spark: SparkSession, base: int, follow_ups: int) -> DataFrame:
    """(sample_id, text, paraphrase_of): questions, then repeats and paraphrases of them in turns."""
    first = spark.range(base).select(F.concat(F.lit("faq-"), "id").alias("sample_id"), F.concat(F.lit("What is the policy on "), pick(TOPICS, F.col("id")), F.lit(" number "), "id", F.lit("?")).alias("text"), F.lit(None).cast("string").alias("paraphrase_of"))
    later = spark.range(follow_ups).withColumn("of", F.pmod(F.xxhash64("id"), F.lit(base)))
    body = F.concat(F.lit("policy on "), pick(TOPICS, F.col("of")), F.lit(" number "), "of", F.lit("?"))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("What is the "), body)).otherwise(F.concat(F.lit("Can you explain the "), body))
    return first.unionByName(later.select(F.concat(F.lit("faq-"), F.col("id") + base).alias("sample_id"), text.alias("text"), F.concat(F.lit("faq-"), "of").alias("paraphrase_of")))


def calibration_pairs(spark: SparkSession, n: int, classes: list[str]) -> DataFrame:
    """(request_class, input, reference, compressed): the compressed side is the first half of the input's words."""
    rows = spark.range(n).select(pick(classes, F.col("id")).alias("request_class"), F.concat(F.lit("Please explain "), pick(TOPICS, F.col("id")), F.lit(" with at most "), "id", F.lit(" words and never mention "), pick(TOPICS, F.col("id"), F.lit(1))).alias("input"))
    words = F.split("input", " ")
    return rows.select("request_class", "input", F.col("input").alias("reference"), F.array_join(F.slice(words, 1, F.ceil(F.size(words) / 2).cast("int")), " ").alias("compressed"))
