"""Streaming forms of batch queries: the same rows from micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import REQUEST_LOG, REQUESTS_SQL, micros
from ..streaming import windows as W
from .control import STATES_SQL
from .registry import query


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.event_stream(spark, f"{sf_dir}/events.parquet").selectExpr(*(f"{e} AS {n}" for n, e in REQUEST_LOG.items()))


@query(f"SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day, count(*) AS n, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved FROM {REQUESTS_SQL} GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.drain(W.hourly(stream(spark, sf_dir)), "complete")
    return out.select(F.hour("w.start").alias("hour"), F.day("w.start").alias("day"), "n", "tokens_saved")


@query(f"SELECT request_id, concat_ws(':', strategy_id, request_class) AS cell, state FROM ({STATES_SQL}) JOIN (SELECT request_id, strategy_id, request_class FROM {REQUESTS_SQL}) USING (request_id)")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir).withColumn("cell", F.concat_ws(":", "strategy_id", "request_class")).withColumn("at", F.expr(micros()) / 1e6)
    return W.drain(W.breaker(rows))
