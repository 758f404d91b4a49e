"""Queries over control loops and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrow as P
from ..operators import calibrate as K, control as C, sequential
from ..sources.tables import REQUESTS_SQL, load, micros, request_log
from .benchmarks import pairs
from .registry import query


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log with cell, day and at (seconds)."""
    return request_log(spark, sf_dir).withColumn("cell", F.concat_ws(":", "strategy_id", "request_class")).withColumn("day", F.expr("unix_date(CAST(ts AS DATE))")).withColumn("at", F.expr(micros()) / 1e6)


@query(f"""SELECT request_id, round(least(1.0, CASE WHEN request_id % 1500 < 100 THEN 0.20 WHEN request_id % 1500 < 300 THEN 0.10 WHEN request_id % 1500 < 1000 THEN 0.03 ELSE 0.015 END * CASE WHEN strategy_id = 'S7' THEN 5 ELSE 1 END * CASE WHEN request_id % 9 = 0 THEN 3 ELSE 1 END), 6) AS rate FROM {REQUESTS_SQL}""")
def adaptive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rid = F.col("request_id")
    return request_log(spark, sf_dir).select("request_id", F.round(C.sampling_rate(rid % 1500, F.col("strategy_id"), rid % 9 == 0), 6).alias("rate"))


@query(f"""SELECT request_id, CAST(row_number() OVER (PARTITION BY strategy_id, request_class, CAST(ts AS DATE) ORDER BY ts, request_id) <= 5 OR CAST('0x' || left(md5(request_id || ':0'), 8) AS BIGINT) / 4294967296.0 < 0.1 AS INTEGER) AS sampled FROM {REQUESTS_SQL}""")
def daily_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sampled(cells(spark, sf_dir).withColumn("rate", F.lit(0.1))).select("request_id", "sampled")


@query(f"""SELECT request_id, CAST(n AS BIGINT) AS n, CAST(t AS BIGINT) AS total_bp, CAST(l AS BIGINT) AS low, CAST(n >= 10 AND (t < 9500 * n OR l * 50 > n) AS INTEGER) AS open FROM (SELECT request_id, count(*) OVER w AS n, sum(parity_bp) OVER w AS t, sum(CAST(parity_bp < 8500 AS INTEGER)) OVER w AS l
FROM {REQUESTS_SQL} WINDOW w AS (PARTITION BY strategy_id, request_class ORDER BY ts, request_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))""")
def circuit_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rolling_breaker(cells(spark, sf_dir)).select("request_id", "n", "total_bp", "low", "open")


#: A cell is disabled by the first open evaluation that follows another one within a day.
STATES_SQL = f"""WITH r AS (SELECT request_id, strategy_id, request_class, ts, count(*) OVER w AS n, sum(parity_bp) OVER w AS t, sum(CAST(parity_bp < 8500 AS INTEGER)) OVER w AS l
FROM {REQUESTS_SQL} WINDOW w AS (PARTITION BY strategy_id, request_class ORDER BY ts, request_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, n >= 10 AND (t < 9500 * n OR l * 50 > n) AS open FROM r),
b AS (SELECT *, max(CASE WHEN open THEN epoch_us(ts) END) OVER (PARTITION BY strategy_id, request_class ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
d AS (SELECT *, max(CAST(coalesce(open AND epoch_us(ts) - last < 86400000000, false) AS INTEGER)) OVER (PARTITION BY strategy_id, request_class ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS off FROM b)
SELECT request_id, CASE WHEN off = 1 THEN 'DISABLED' WHEN open THEN 'OPEN' ELSE 'CLOSED' END AS state FROM d"""


@query(STATES_SQL)
def circuit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.circuit_states(cells(spark, sf_dir))


REWARD = "CAST(floor(greatest(0, parity_bp - 8500) * 10000 / 1500 - (10000 - tokens_saved) / 4) AS BIGINT)"


@query(f"""SELECT strategy_id, request_class, arm, round(1.0 + sum(CASE WHEN r > 0 THEN r ELSE 0 END) / 10000.0, 4) AS alpha, round(1.0 + sum(CASE WHEN r > 0 THEN 0 ELSE -r END) / 10000.0, 4) AS beta FROM (SELECT *, {REWARD} AS r FROM {REQUESTS_SQL}) GROUP BY ALL""")
def bandit_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).withColumn("reward_bp", C.reward_bp(F.col("parity_bp"), F.col("tokens_saved")))
    return C.posteriors(rows).select("strategy_id", "request_class", "arm", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


@query()
def bandit_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).withColumn("reward_bp", C.reward_bp(F.col("parity_bp"), F.col("tokens_saved")))
    is_open = rows.where("strategy_id = 'S7'").select("strategy_id", "request_class").distinct()
    valued = C.posteriors(rows).withColumn("arm", C.arm_value(F.col("strategy_id"), F.col("arm")))
    return C.select_arms(valued, is_open)


@query(f"""SELECT request_id, round(reuses * tokens_saved * 3e-6 * 0.5e0, 9) AS lhs, CASE WHEN shadow_micros > 0 THEN round(reuses * tokens_saved * 3e-6 * 0.5e0 / (5e0 * (shadow_micros / 1e6)), 6) ELSE 'inf'::DOUBLE END AS ratio,
CAST(reuses * tokens_saved * 3e-6 * 0.5e0 > 5e0 * (shadow_micros / 1e6) AS INTEGER) AS passed FROM (SELECT *, request_id % 20 AS reuses FROM {REQUESTS_SQL})""")
def breakeven(spark: SparkSession, sf_dir: str) -> DataFrame:
    lhs, ratio, passed = C.breakeven(F.col("request_id") % 20, F.col("tokens_saved"), F.lit(0.000003), F.lit(0.5), F.col("shadow_micros") / 1e6)
    return request_log(spark, sf_dir).select("request_id", F.round(lhs, 9).alias("lhs"), F.round(ratio, 6).alias("ratio"), passed.cast("int").alias("passed"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(P.rouge_l("a", "b"), 6).alias("rouge_l"))


@query(f"""SELECT coalesce(request_class, 'overall') AS request_class, round(sum(CAST((cache_result IS NOT NULL AND contains(lower(coalesce(cache_result, '')), 'l')) = (request_id % 3 <> 0) AS INTEGER)) / count(*), 4) AS recall FROM {REQUESTS_SQL} GROUP BY ROLLUP (request_class)""")
def constraint_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter l as a constraint of the cache result, negative for every third request."""
    rows = request_log(spark, sf_dir).select("request_class", F.coalesce("cache_result", F.lit("")).alias("text"), F.lit("L").alias("constraint"), (F.col("request_id") % 3 != 0).alias("positive"))
    return K.constraint_recall(rows)


@query(f"""WITH g AS (SELECT unnest([0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]::DOUBLE[]) AS tau), s AS (SELECT request_class, tau, sum(CASE WHEN qps_milli / 1000.0 >= tau + 0.0 THEN parity_bp % 1000 - 450 ELSE 0 END) AS score FROM {REQUESTS_SQL}, g GROUP BY ALL)
SELECT request_class, arg_max(tau, score * 100 - tau) AS tau, CAST(max(score) AS BIGINT) AS score FROM s GROUP BY request_class""")
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).select("request_class", (F.col("qps_milli") / 1000).alias("similarity"), (F.col("parity_bp") % 1000).alias("gain"), F.lit(450).alias("loss"))
    return K.tau_sweep(rows)


@query()
def qps_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).select((F.col("parity_bp") / 10_000).alias("coverage"), (F.col("qps_milli") / 1000).alias("semantic"), (F.col("tokens_saved") / 1500).alias("window"), (F.col("latency_ms") / 700).alias("margin"))
    rows = rows.withColumn("human", 0.5 * F.col("coverage") + 0.3 * F.col("semantic") + 0.2 * F.col("window"))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in K.quality_weights(rows).items()], "name string, weight double")


@query()
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).select(F.col("tokens_in").cast("double"), F.col("latency_ms").cast("double"), F.col("rollback_stage").isNotNull().cast("double").alias("label"))
    model = K.train_binary(rows, ["tokens_in", "latency_ms"], "label")
    return spark.createDataFrame([("intercept", float(model.intercept))] + [(n, float(c)) for n, c in zip(["tokens_in", "latency_ms"], model.coefficients.toArray(), strict=True)], "name string, weight double")


@query(f"SELECT request_class, CAST(CASE WHEN sum(CAST(parity_bp >= 8500 AS INTEGER)) / count(*) < 0.984 THEN 3 ELSE 2 END AS INTEGER) AS alpha, 1 AS beta FROM {REQUESTS_SQL} GROUP BY request_class")
def bandit_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall limit is moved to where these classes differ."""
    recall = F.sum((F.col("parity_bp") >= 8500).cast("int")) / F.count("*") - (0.984 - C.RECALL_BUMP)
    return request_log(spark, sf_dir).groupBy("request_class").agg(C.conservative_prior(recall).alias("alpha"), F.lit(1).alias("beta"))


@query()
def pair_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "a", F.left("a", F.lit(50)).alias("b"), F.col("b").alias("reference"), F.array(F.lit("the"), F.lit("und")).alias("constraints"))
    out = K.judge_pairs(rows)
    return out.select("id", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"), "winner")


@query("""SELECT c_nationkey AS nation, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def cost_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a cost roll-up over the star schema; orders are summed by customer before the join."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    return orders.join(load(spark, sf_dir, "customer"), orders.o_custkey == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("cents").alias("cents"), F.sum("n").alias("n_orders"))
