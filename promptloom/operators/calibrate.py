"""Calibration: overlap scores, threshold sweeps, recall and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arrow as P

TAU_GRID = [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
DEFAULT_WEIGHTS = {"coverage": 0.45, "semantic": 0.30, "window": 0.15, "margin": 0.10}
LEAST_ROWS = 20


def tau_sweep(scored: DataFrame) -> DataFrame:
    """(request_class, tau): of scored (request_class, similarity, gain, loss) the threshold whose accepted pairs (similarity >= tau) gain most less
    their losses, the smallest of equal ones. The grid is summed in one pass."""
    sums = scored.groupBy("request_class").agg(*(F.sum(F.when(F.col("similarity") >= t, F.col("gain") - F.col("loss")).otherwise(0)).alias(f"t{k}") for k, t in enumerate(TAU_GRID)))
    rows = F.array(*(F.struct(F.col(f"t{k}").alias("score"), F.lit(-t).alias("neg")) for k, t in enumerate(TAU_GRID)))
    best = F.array_max(rows)
    return sums.select("request_class", (-best["neg"]).alias("tau"), best["score"].alias("score"))


def constraint_recall(pairs: DataFrame) -> DataFrame:
    """(request_class, recall) of (request_class, text, constraint, positive): positive ones must be in the text, negative ones not; with the mean over
    all as class 'overall'."""
    ok = (F.contains(F.lower("text"), F.lower("constraint")) == F.col("positive")).cast("int")
    rows = pairs.select("request_class", ok.alias("ok"))
    return rows.rollup("request_class").agg(F.round(F.sum("ok") / F.count("*"), 4).alias("recall")).select(F.coalesce("request_class", F.lit("overall")).alias("request_class"), "recall")


def quality_weights(rows: DataFrame) -> dict[str, float]:
    """Least-squares weights without intercept, negatives cut to 0, scaled to sum to 1; the defaults if there are few rows or nothing is left.

    One aggregation gives the ten different sums of the normal equations; only these reach the driver.
    """
    import numpy as np

    keys = list(DEFAULT_WEIGHTS)
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(keys) for b in keys[i:]] + [F.sum(F.col(a) * F.col("human")).alias(f"{a}_y") for a in keys]
    got = rows.agg(F.count("*").alias("n"), *cells).first()
    if got["n"] < LEAST_ROWS:
        return dict(DEFAULT_WEIGHTS)
    gram = np.array([[got[f"{a}_{b}"] if i <= j else got[f"{b}_{a}"] for j, b in enumerate(keys)] for i, a in enumerate(keys)])
    solved = np.clip(np.linalg.lstsq(gram, np.array([got[f"{a}_y"] for a in keys]), rcond=None)[0], 0, None)
    if solved.sum() <= 0:
        return dict(DEFAULT_WEIGHTS)
    return {k: float(w) for k, w in zip(keys, solved / solved.sum(), strict=True)}


def judge_pairs(rows: DataFrame, tie: float = 0.05) -> DataFrame:
    """(id, score_a, score_b, winner) of (id, a, b, reference, constraints): 0.6 ROUGE-L and 0.4 recall of the constraints; close ones tie."""
    recall = lambda c: F.when(F.size("constraints") == 0, F.lit(1.0)).otherwise(F.size(F.filter("constraints", lambda x: F.contains(F.lower(c), F.lower(x)))) / F.size("constraints"))
    scored = rows.withColumn("score_a", 0.6 * P.rouge_l("a", "reference") + 0.4 * recall("a")).withColumn("score_b", 0.6 * P.rouge_l("b", "reference") + 0.4 * recall("b"))
    gap = F.col("score_a") - F.col("score_b")
    return scored.select("id", "score_a", "score_b", F.when(F.abs(gap) < tie, "tie").when(gap > 0, "a").otherwise("b").alias("winner"))


def train_binary(rows: DataFrame, columns: list[str], label: str):
    """L2 logistic regression on numeric columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows)
    return LogisticRegression(labelCol=label, maxIter=50, regParam=0.01).fit(data)
