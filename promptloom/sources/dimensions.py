"""Small dimension tables: routing, class settings, life times, prices. All are constants of a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import CLASSES, STRATEGIES

A, R, D = "ALLOWED", "RESTRICTED", "DISABLED"
# Fixed values, one row a class: status of S1..S7, whether semantic cache serving is allowed, its threshold.
ROUTING = {
    "EXTRACTION": ([A, A, R, D, A, A, D], True, 0.97),
    "REASONING": ([A, A, R, D, A, A, D], True, 0.97),
    "SUMMARIZATION": ([A, A, A, A, A, A, A], True, 0.95),
    "GENERATION_FACTUAL": ([A, A, A, A, A, A, D], True, 0.96),
    "GENERATION_CREATIVE": ([A, A, R, D, A, A, D], False, None),
    "CLASSIFICATION_SHORT": ([A, A, A, D, D, A, D], True, 0.93),
    "AGENT_TOOL_LOOP": ([A, A, A, A, A, A, D], False, None),
    "CHAT_OPEN": ([A, A, R, D, A, A, A], False, None),
}
RESTRICTED_FLOOR = 0.97
# Seconds that an exact-cache entry lives.
LIFE_TIMES = {"CLASSIFICATION_SHORT": 604800, "EXTRACTION": 259200, "GENERATION_FACTUAL": 259200, "SUMMARIZATION": 259200, "REASONING": 259200, "GENERATION_CREATIVE": 86400, "AGENT_TOOL_LOOP": 3600, "CHAT_OPEN": 86400, "AMBIGUOUS": 86400}
DEFAULT_LIFE_TIME = 86400
# Provider, input and output price in USD per million tokens, share of the input price that a cache hit saves.
PRICES = [("groq", 0.59, 0.79, 0.0), ("mistral", 0.20, 0.60, 0.0), ("cohere", 0.15, 0.60, 0.0), ("mock", 0.59, 0.79, 0.0), ("anthropic", 3.0, 15.0, 0.90), ("openai", 2.5, 10.0, 0.50)]


# What the nine providers' own prompt cache keeps, and the tokens of their context.
CAPABILITIES = [("openai", "prefix", 128_000), ("anthropic", "prefix", 200_000), ("cohere", "none", 128_000), ("deepseek", "none", 128_000), ("gemini", "none", 1_048_576), ("groq", "none", 131_072), ("mistral", "none", 32_768), ("ollama", "none", 32_768), ("openrouter", "none", 200_000)]


def routing_rows() -> list[tuple]:
    """(request_class, strategy, status, floor, l1_allowed, l1_tau), one row a class and strategy."""
    return [(c, s, status, RESTRICTED_FLOOR if status == R else None, int(l1), tau) for c in CLASSES for (statuses, l1, tau) in [ROUTING[c]] for s, status in zip(STRATEGIES, statuses, strict=True)]


ROUTING_COLUMNS = "request_class string, strategy string, status string, floor double, l1_allowed int, l1_tau double"


def routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(routing_rows(), ROUTING_COLUMNS)


def life_times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LIFE_TIMES.items()), "request_class string, ttl_seconds long")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, input_price double, output_price double, cache_discount double")


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "provider string, native_prompt_cache string, max_context long")
