"""Aggregates over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

QPS_BUCKETS = [0.80, 0.85, 0.90, 0.95, 0.98, 0.99, 1.0]
LATENCY_BUCKETS = [10, 25, 50, 100, 200, 500]
LEVELS = ["l0", "l1", "l2"]


def summary(log: DataFrame) -> DataFrame:
    """Totals a tenant; sums are whole numbers (tokens, micro-USD, thousandths) until the last step."""
    return log.groupBy("tenant_id").agg(
        F.count("*").alias("total_requests"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), F.round(F.coalesce(F.sum("saved_micros"), F.lit(0)) / 1e6, 6).alias("cost_saved_usd"),
        F.round(F.coalesce(F.sum("qps_milli") / F.count("qps_milli"), F.lit(0.0)) / 1000, 4).alias("avg_qps"), F.count("rollback_stage").alias("rollbacks"),
    )


def cache_level(result: Column) -> Column:
    """l0, l1 or l2 by the JSON's level or cache, 'miss' for all else, broken JSON too; null stays null."""
    found = F.lower(F.coalesce(F.get_json_object(result, "$.level"), F.get_json_object(result, "$.cache")))
    return F.when(result.isNotNull(), F.when(found.isin(LEVELS), found).otherwise("miss"))


def strategy_counts(log: DataFrame) -> DataFrame:
    used = log.select("tenant_id", F.explode(F.from_json("strategies", "array<string>")).alias("strategy"))
    return used.groupBy("tenant_id", "strategy").agg(F.count("*").alias("n"))


def histogram(log: DataFrame, value: Column, buckets: list[float], labels: list[str]) -> DataFrame:
    """Cumulative numbers of values up to each bound: one pass that counts all bounds, then one row a bound."""
    counts = log.groupBy(*labels).agg(*(F.count_if(value <= b).alias(f"b{k}") for k, b in enumerate(buckets)), F.count(value).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(buckets)), F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return counts.select(*labels, F.explode(rows).alias("x")).select(*labels, "x.le", "x.n")


def resolve_tenants(log: DataFrame, keys: DataFrame, default: str = "default") -> DataFrame:
    """Tenant of each request's API key, the default for keys nobody has."""
    return log.join(F.broadcast(keys), "api_key", "left").withColumn("tenant_id", F.coalesce("tenant_id", F.lit(default)))


def storable(log: DataFrame, tenants: DataFrame) -> DataFrame:
    """Cache writes allowed: rows of tenants that do not forbid storing."""
    return log.join(F.broadcast(tenants.where("no_store").select("tenant_id")), "tenant_id", "left_anti")
