"""Sampling, breaker windows, bandit posteriors and break-even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrow as P

# Arms of three passes and of all others.
ARMS = {"S3": [0.88, 0.90, 0.93, 0.97], "S5": [0.70, 0.80, 0.90, 0.95], "S7": [0.80, 0.85, 0.90, 0.95]}
OTHER_ARMS = [0.70, 0.80, 0.90, 0.97]
RECALL_BUMP, SAFETY, DAILY = 0.92, 5.0, 5


def arm_value(strategy: Column, index: Column) -> Column:
    """The pass's arm of this number, from 0; the greatest arm is the most careful."""
    at = (index + 1).cast("int")
    out = F.element_at(F.array(*map(F.lit, OTHER_ARMS)), at)
    for name, arms in ARMS.items():
        out = F.when(strategy == name, F.element_at(F.array(*map(F.lit, arms)), at)).otherwise(out)
    return out


def sampling_rate(n: Column, strategy: Column, probation: Column) -> Column:
    base = F.when(n < 100, 0.20).when(n < 300, 0.10).when(n < 1000, 0.03).otherwise(0.015)
    return F.least(F.lit(1.0), base * F.when(strategy == "S7", 5.0).otherwise(1.0) * F.when(probation, 3.0).otherwise(1.0))


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of an MD5: the same in every engine and on every retry."""
    key = F.concat_ws(":", *(p.cast("string") for p in parts), F.lit(str(seed)))
    return F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def sampled(log: DataFrame, daily: int = DAILY) -> DataFrame:
    """log (request_id, cell, day, at, rate) with sampled: the first ``daily`` of a cell and day always, others by their rate."""
    order = Window.partitionBy("cell", "day").orderBy("at", "request_id")
    return log.withColumn("sampled", ((F.row_number().over(order) <= daily) | (uniform(F.col("request_id")) < F.col("rate"))).cast("int"))


def rolling_breaker(log: DataFrame, window: int = 200) -> DataFrame:
    """log (request_id, cell, at, parity_bp) with open: whether the last ``window`` samples break a limit. Whole numbers throughout."""
    order = Window.partitionBy("cell").orderBy("at", "request_id").rowsBetween(-(window - 1), 0)
    n, total, low = F.count("*").over(order), F.sum("parity_bp").over(order), F.sum((F.col("parity_bp") < 8500).cast("int")).over(order)
    return log.withColumn("n", n).withColumn("total_bp", total).withColumn("low", low).withColumn("open", ((F.col("n") >= 10) & ((F.col("total_bp") < 9500 * F.col("n")) | (F.col("low") * 50 > F.col("n")))).cast("int"))


def posteriors(log: DataFrame, prior_alpha: float = 1.0) -> DataFrame:
    """(strategy_id, request_class, arm, alpha, beta) of log (…, reward_bp): positive rewards add to alpha, others to beta."""
    gain = F.sum(F.when(F.col("reward_bp") > 0, F.col("reward_bp")).otherwise(0))
    loss = F.sum(F.when(F.col("reward_bp") > 0, 0).otherwise(-F.col("reward_bp")))
    return log.groupBy("strategy_id", "request_class", "arm").agg((F.lit(prior_alpha) + gain / 10_000).alias("alpha"), (1 + loss / 10_000).alias("beta"))


def reward_bp(parity_bp: Column, reduction_bp: Column) -> Column:
    """max(0, (parity - .85) / .15) - .25 (1 - reduction), in ten-thousandths and rounded down."""
    return F.floor(F.greatest(F.lit(0), parity_bp - 8500) * 10_000 / 1500 - (10_000 - reduction_bp) / 4)


def select_arms(posterior: DataFrame, open_cells: DataFrame, seed: int = 0) -> DataFrame:
    """(strategy_id, request_class, arm): the greatest posterior draw; in an open cell the greatest arm."""
    draw = P.beta_draw("alpha", "beta", F.xxhash64("strategy_id", "request_class", "arm", F.lit(seed)))
    rows = posterior.withColumn("draw", draw).join(open_cells.select("strategy_id", "request_class", F.lit(True).alias("is_open")), ["strategy_id", "request_class"], "left")
    return rows.groupBy("strategy_id", "request_class").agg(F.when(F.max(F.coalesce("is_open", F.lit(False))), F.max("arm")).otherwise(F.max_by("arm", "draw")).alias("arm"))


def breakeven(reuses: Column, saved: Column, price: Column, discount: Column, cost: Column) -> tuple[Column, Column, Column]:
    """(lhs, ratio, passed): reuses * saved * discounted price against SAFETY times the cost."""
    lhs = reuses * saved * price * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), discount)))
    rhs = SAFETY * cost
    return lhs, F.when(rhs > 0, lhs / rhs).otherwise(F.lit(float("inf"))), lhs > rhs


def conservative_prior(recall: Column) -> Column:
    return F.when(recall < RECALL_BUMP, 3).otherwise(2)
