"""The input tables, and the request log that the event table stands for.

Every expression in REQUEST_LOG is integer arithmetic or a CASE, so that each engine derives the same log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASSES = ["EXTRACTION", "REASONING", "SUMMARIZATION", "GENERATION_FACTUAL", "GENERATION_CREATIVE", "CLASSIFICATION_SHORT", "AGENT_TOOL_LOOP", "CHAT_OPEN"]
STRATEGIES = ["S1", "S2", "S3", "S4", "S5", "S6", "S7"]


def choose(number: str, items: list[str]) -> str:
    """SQL for items[number % len(items)]; None is NULL."""
    arms = " ".join(f"WHEN {k} THEN " + ("NULL" if x is None else f"'{x}'") for k, x in enumerate(items))
    return f"CASE ({number}) % {len(items)} {arms} END"


REQUEST_LOG = {
    "request_id": "event_id",
    "tenant_id": "concat('tenant', CAST(user_id % 20 AS VARCHAR(9)))",
    "user_id": "user_id",
    "ts": "ts",
    "request_class": choose("event_id", CLASSES),
    "provider": choose("event_id % 7", ["openai", "anthropic", "mistral", "cohere"]),
    "tokens_in": "200 + (event_id * 7919) % 6000",
    "tokens_saved": "(event_id * 104729) % 1500",
    "tokens_out": "50 + event_id % 300",
    "saved_micros": "((event_id * 104729) % 1500) * 3",
    "shadow_micros": "(event_id * 31) % 700",
    "qps_milli": "800 + (event_id * 31) % 201",
    "latency_ms": "(event_id * 131) % 700",
    "parity_bp": "CASE WHEN event_id % 61 = 0 THEN 7000 ELSE 9300 + (event_id * 613) % 700 END",
    "rollback_stage": "CASE WHEN event_id % 17 = 0 THEN 'S7' WHEN event_id % 23 = 0 THEN 'S3' END",
    "cache_result": choose("event_id", ['{"level":"l0"}', '{"cache":"L1"}', '{"level":"weird"}', "not json", None, '{"level":"l2"}']),
    "strategies": choose("event_id", ['["S1","S6"]', '["S6"]', '["S3","S6","S1"]', None]),
    "strategy_id": choose("event_id % 11", STRATEGIES),
    "arm": "event_id % 3",
    "query_key": "event_id % 997",
}
REQUESTS_SQL = f"(SELECT {', '.join(f'{e} AS {n}' for n, e in REQUEST_LOG.items())} FROM events)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in REQUEST_LOG.items()))


def micros(column: str = "ts") -> str:
    """SQL for microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return f"unix_date(CAST({column} AS DATE)) * 86400000000 + CAST(hour({column}) * 3600 + minute({column}) * 60 AS BIGINT) * 1000000 + CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)"


def quoted(value: object) -> str:
    """A literal that either engine reads; line ends go by their code point, since only one of them knows escapes."""
    if value is None:
        return "NULL"
    if not isinstance(value, str):
        return str(value)
    parts = ["'" + part.replace("'", "''") + "'" for part in value.split("\n")]
    return parts[0] if len(parts) == 1 else f"concat({', chr(10), '.join(parts)})"


def literal(rows: list[tuple], columns: list[str]) -> str:
    """A VALUES relation of numbers, strings and None, without backslashes."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({', '.join(columns)}))"
