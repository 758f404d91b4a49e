"""S4: documents that a conversation has seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions import text as T

MIN_TOKENS, TOP, FALLBACK_FLOOR, CONFIDENT = 2000, 5, 0.90, 0.35


def applies(query: Column, tokens: Column, conversation: Column, status: Column, min_tokens: int = MIN_TOKENS) -> Column:
    return ~T.has_word(query, T.FULL_DOCUMENT) & (tokens >= min_tokens) & conversation.isNotNull() & (status != "DISABLED")


def repeats(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``docs`` with doc_hash and repeat (1 if the keys have had the text before); the first is found by a minimum, not by sorting groups."""
    hashed = docs.withColumn("doc_hash", F.sha2("text", 256))
    first = hashed.groupBy(*keys, "doc_hash").agg(F.min(order).alias("first"))
    return hashed.join(first, [*keys, "doc_hash"]).withColumn("repeat", (F.col(order) > F.col("first")).cast("int")).drop("first")


def replacement(scored: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, text): a header and the five best chunks in their order; if even the best is not confident, the chunks that hold 90 % of the tokens."""
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "chunk_idx")
    rows = scored.withColumn("rank", F.row_number().over(order)).withColumn("mass", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("total", F.sum("tokens").over(Window.partitionBy("id"))).withColumn("best", F.max("score").over(Window.partitionBy("id")))
    kept = rows.where(F.when(F.col("best") >= CONFIDENT, F.col("rank") <= TOP).otherwise(F.col("mass") < FALLBACK_FLOOR * F.col("total")))
    body = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda r: r["chunk"]), "\n").alias("body"))
    head = F.concat(F.lit("Document "), F.left("doc_hash", F.lit(8)), F.lit(' "'), F.col("title"), F.lit('", available — relevant excerpts below'))
    return body.join(titles, "id").select("id", F.concat(head, F.lit("\n"), F.col("body")).alias("text"))
