"""The end-to-end query: every conversation through all passes and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import classify, optimizer, segments as S
from ..sources.dimensions import routing
from .registry import query
from .requests import conversations


def routes_of(spark: SparkSession, segs: DataFrame, queries: DataFrame) -> DataFrame:
    """(request_id, strategy, status) by the class that the rules give."""
    has = lambda kind: F.bool_or(F.col("segment_type") == kind)
    system = F.array_join(F.collect_list(F.when(F.col("role") == "system", F.col("text"))), "\n")
    rows = segs.groupBy("request_id").agg(has("RETRIEVED_DOC").alias("has_doc"), F.bool_or(F.col("role") == "system").alias("has_system"), system.alias("system_text"), has("TOOL_SCHEMA").alias("has_tools"), has("TOOL_RESULT").alias("has_tool_result"))
    rows = rows.join(queries, "request_id", "left").withColumn("query", F.coalesce("query", F.lit("")))
    kinds = classify.classify(rows).select("request_id", F.col("primary_class").alias("request_class"))
    return kinds.join(F.broadcast(routing(spark)), "request_class").select("request_id", "strategy", "status")


@query()
def optimize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds for conversations of a few turns: documents over 200 tokens, the last two groups of turns kept; prefixes of 100 bytes are cached."""
    conv = conversations(spark, sf_dir)
    segs = S.segments(conv)
    opted = segs.where("request_id % 2 = 0").select("request_id").distinct()
    queries = S.final_user_query(conv)
    prefixes = segs.select("request_id").distinct().select("request_id", F.lit(100).alias("prefix_bytes"), F.lit(3).alias("price"), F.lit(60).alias("cache_value"))
    outcome, _ = optimizer.optimise(segs, queries, opted, routes_of(spark, segs, queries), prefixes, doc_budget=200, keep=2, depth=3, min_turns=200, min_doc=100, lossy_budget=200)
    return outcome.withColumn("saved", F.col("tokens_before") - F.col("tokens_after"))
