"""Queries over the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import gate as G, manifest as M, segments as S
from ..sources.tables import REQUESTS_SQL, request_log
from .registry import query
from .requests import conversations, sql_word


@query(f"""SELECT request_id, round(CASE WHEN request_id % 13 = 0 OR request_id % 29 = 0 THEN 0.0 ELSE 0.45 + 0.30 * (tokens_saved % 100) / 100.0 + 0.15 * (latency_ms % 50) / 50.0 + 0.10 * least(1.0, greatest(0.0, (qps_milli / 1000.0 - 0.9) / 0.1)) END, 6) AS qps,
CASE WHEN strategy_id = 'S7' THEN 0.99 ELSE 0.98 END AS floor FROM {REQUESTS_SQL}""")
def qps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir)
    rid = F.col("request_id")
    coverage = F.when(rid % 13 == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    score = G.quality(coverage, rid % 29 != 0, (F.col("tokens_saved") % 100) / 100, (F.col("latency_ms") % 50) / 50, F.col("qps_milli") / 1000)
    return rows.select("request_id", F.round(score, 6).alias("qps"), G.floor(F.col("strategy_id") == "S7").alias("floor"))


ATTEMPTS = "(request_id * (7 + 6 * i)) % 40"


@query(f"""WITH a AS (SELECT request_id, i, list_extract(['none', 'S7', 'S4', 'S3', 'S5', 'S1'], CAST(i AS INTEGER) + 1) AS stage, {ATTEMPTS} >= 32 AS passed FROM {REQUESTS_SQL}, generate_series(0, 5) AS g(i))
SELECT request_id, coalesce(arg_min(stage, i) FILTER (WHERE passed), 'raw') AS stage FROM a GROUP BY request_id""")
def rollback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six attempts a request with made-up scores of 0.66 to 1.05."""
    stages = F.array(*map(F.lit, ["none", *G.ROLLBACK_ORDER]))
    rows = request_log(spark, sf_dir).select("request_id", F.posexplode(stages).alias("i", "stage"))
    score = (F.col("request_id") * (7 + 6 * F.col("i"))) % 40 + 66
    return G.rollback(rows.select("request_id", "stage", score.alias("qps"), F.lit(98).alias("floor")))


@query("""SELECT conv_id AS request_id, turn AS seg_idx, CASE WHEN conv_id % 3 = 0 THEN left(text, 30) WHEN conv_id % 3 = 1 THEN left(text, 60) ELSE text END AS text FROM conversations""")
def rollback_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every segment; what a rollback to before the third, second or no pass gives."""
    segs = S.segments(conversations(spark, sf_dir))
    version = lambda k, text: segs.select("request_id", F.lit(k).alias("stage_idx"), "seg_idx", text.alias("text"))
    every = version(0, F.col("text")).unionByName(version(1, F.left("text", F.lit(60)))).unionByName(version(2, F.left("text", F.lit(30))))
    undone = segs.select("request_id").distinct().select("request_id", (3 - F.col("request_id") % 3).alias("undo_idx"))
    return G.snapshot_after(every, undone)


@query()
def window_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.joined_texts(S.segments(conversations(spark, sf_dir))).select(F.col("request_id").alias("id"), F.col("full_text").alias("original"), F.regexp_replace("full_text", r"\b(the|and) ", "").alias("rewritten"))
    return G.window_fidelity(rows).select("id", F.round("fidelity", 6).alias("fidelity"))


@query(f"""WITH p AS (SELECT conv_id, turn, text AS old, CASE WHEN conv_id % 2 = 0 THEN left(text, 40) ELSE 'I cannot do ' || text END AS new FROM conversations)
SELECT conv_id, turn, round((1 + CAST(length(new) / greatest(length(old), 1) BETWEEN 0.5 AND 2.0 AS INTEGER) + CAST({sql_word('new', T.REFUSALS)} = {sql_word('old', T.REFUSALS)} AS INTEGER)) / 3, 6) AS checks FROM p""")
def parity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("conv_id") % 2 == 0, F.left("text", F.lit(40))).otherwise(F.concat(F.lit("I cannot do "), "text"))
    return conversations(spark, sf_dir).select("conv_id", "turn", F.round(G.task_checks(new, F.col("text")), 6).alias("checks"))


@query()
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.left("text", (F.length("text") * 0.8).cast("int"))
    score = G.parity(new, F.col("text"), M.entities(new), M.entities(F.col("text")))
    return conversations(spark, sf_dir).select("conv_id", "turn", F.round(score, 6).alias("parity"))
