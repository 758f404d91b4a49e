"""Queries over telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sequential, telemetry as A
from ..sources.tables import REQUESTS_SQL, micros, request_log
from .registry import query


@query(f"SELECT request_id, CAST(saved_micros - shadow_micros AS BIGINT) AS net_micros, tokens_out FROM {REQUESTS_SQL}")
def net_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).select("request_id", (F.col("saved_micros") - F.coalesce("shadow_micros", F.lit(0))).alias("net_micros"), "tokens_out")


@query(f"SELECT tenant_id, count(*) AS total_requests, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, round(sum(saved_micros) / 1e6, 6) AS cost_saved_usd, round(CAST(sum(qps_milli) AS DOUBLE) / count(*) / 1000, 4) AS avg_qps, count(rollback_stage) AS rollbacks FROM {REQUESTS_SQL} GROUP BY tenant_id")
def dash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(request_log(spark, sf_dir))


@query(f"""SELECT tenant_id, CASE WHEN json_valid(cache_result) AND lower(coalesce(cache_result ->> '$.level', cache_result ->> '$.cache')) IN ('l0', 'l1', 'l2') THEN lower(coalesce(cache_result ->> '$.level', cache_result ->> '$.cache')) ELSE 'miss' END AS level, count(*) AS n
FROM (SELECT tenant_id, CASE WHEN cache_result LIKE '{{%' THEN cache_result ELSE '{{}}' END AS cache_result FROM {REQUESTS_SQL} WHERE cache_result IS NOT NULL) GROUP BY ALL""")
def dash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).where("cache_result IS NOT NULL")
    return rows.groupBy("tenant_id", A.cache_level(F.col("cache_result")).alias("level")).agg(F.count("*").alias("n"))


@query(f"SELECT tenant_id, strategy, count(*) AS n FROM (SELECT tenant_id, unnest(string_split(replace(replace(replace(strategies, '[', ''), ']', ''), '\"', ''), ',')) AS strategy FROM {REQUESTS_SQL} WHERE strategies IS NOT NULL) GROUP BY ALL")
def dash_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.strategy_counts(request_log(spark, sf_dir))


@query(f"SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS n, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved FROM {REQUESTS_SQL} GROUP BY 1")
def dash_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).groupBy(F.expr(f"({micros()}) div 3600000000").alias("hour")).agg(F.count("*").alias("n"), F.sum("tokens_saved").alias("tokens_saved"))


@query(f"SELECT request_id, tenant_id, tokens_saved FROM {REQUESTS_SQL} ORDER BY ts DESC, request_id LIMIT 20")
def dash_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: each task sends its own twenty."""
    return request_log(spark, sf_dir).orderBy(F.col("ts").desc(), "request_id").limit(20).select("request_id", "tenant_id", "tokens_saved")


@query(f"SELECT provider, request_class, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, count(rollback_stage) AS rollbacks FROM {REQUESTS_SQL} GROUP BY ALL")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    return log.groupBy("provider", "request_class").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "tokens_saved")), F.count("rollback_stage").alias("rollbacks"))


@query(f"SELECT provider, le, count(*) FILTER (WHERE latency_ms <= le) AS n FROM {REQUESTS_SQL}, (SELECT unnest([10.0, 25, 50, 100, 200, 500, 'inf'::DOUBLE]::DOUBLE[]) AS le) GROUP BY ALL")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(request_log(spark, sf_dir), F.col("latency_ms"), A.LATENCY_BUCKETS, ["provider"])


@query(f"SELECT request_class, le, count(*) FILTER (WHERE qps_milli <= round(le * 1000)) AS n FROM {REQUESTS_SQL}, (SELECT unnest([0.80, 0.85, 0.90, 0.95, 0.98, 0.99, 1.0, 1000000.0]::DOUBLE[]) AS le) GROUP BY ALL")
def metric_quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.histogram(request_log(spark, sf_dir), F.col("qps_milli"), [round(b * 1000) for b in A.QPS_BUCKETS], ["request_class"])
    return rows.select("request_class", F.when(F.col("le") > 1e6, 1e6).otherwise(F.col("le") / 1000).alias("le"), "n")


@query(f"SELECT request_id, CAST(row_number() OVER (PARTITION BY tenant_id, CAST(ts AS DATE) ORDER BY epoch_us(ts), request_id) <= 10 AS INTEGER) AS optimised FROM {REQUESTS_SQL}")
def quota_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.quota_decisions(quota_log(spark, sf_dir), 10, None)


def quota_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).select("request_id", "tenant_id", F.expr("CAST(unix_date(CAST(ts AS DATE)) AS BIGINT)").alias("day"), F.expr(micros()).alias("at"), F.col("tokens_in").alias("tokens"))


@query(f"""WITH RECURSIVE r AS (SELECT request_id, tenant_id, CAST(ts AS DATE) AS day, tokens_in AS tokens, row_number() OVER (PARTITION BY tenant_id, CAST(ts AS DATE) ORDER BY epoch_us(ts), request_id) AS n FROM {REQUESTS_SQL}),
s AS (SELECT request_id, tenant_id, day, n, CAST(tokens <= 20000 AS INTEGER) AS optimised, CAST(tokens <= 20000 AS INTEGER) AS requests, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END AS used FROM r WHERE n = 1
UNION ALL SELECT r.request_id, r.tenant_id, r.day, r.n, CAST(s.requests < 12 AND s.used + r.tokens <= 20000 AS INTEGER), s.requests + CAST(s.requests < 12 AND s.used + r.tokens <= 20000 AS INTEGER), s.used + CASE WHEN s.requests < 12 AND s.used + r.tokens <= 20000 THEN r.tokens ELSE 0 END
FROM s JOIN r ON r.tenant_id = s.tenant_id AND r.day = s.day AND r.n = s.n + 1) SELECT request_id, optimised FROM s""")
def quota_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.quota_decisions(quota_log(spark, sf_dir), 12, 20_000)


@query(f"SELECT request_id FROM {REQUESTS_SQL} WHERE tenant_id NOT IN ('tenant3', 'tenant7')")
def no_store_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = spark.createDataFrame([("tenant3", True), ("tenant7", True), ("tenant1", False)], "tenant_id string, no_store boolean")
    return A.storable(request_log(spark, sf_dir), tenants).select("request_id")


@query("SELECT event_id AS request_id, CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'default' END AS tenant_id FROM events")
def tenant_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([("k0", "alpha"), ("k1", "beta")], "api_key string, tenant_id string")
    log = request_log(spark, sf_dir).select("request_id", F.concat(F.lit("k"), F.col("user_id") % 4).alias("api_key"))
    return A.resolve_tenants(log, keys).select("request_id", "tenant_id")


@query(f"SELECT provider, request_class, count(*) AS n, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved FROM {REQUESTS_SQL} GROUP BY ROLLUP (provider, request_class)")
def savings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sub-totals."""
    return request_log(spark, sf_dir).rollup("provider", "request_class").agg(F.count("*").alias("n"), F.sum("tokens_saved").alias("tokens_saved"))


@query(f"SELECT provider, request_class, rollback_stage, count(*) AS n FROM {REQUESTS_SQL} GROUP BY CUBE (provider, request_class, rollback_stage)")
def requests_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: all sub-totals."""
    return request_log(spark, sf_dir).cube("provider", "request_class", "rollback_stage").agg(F.count("*").alias("n"))
