"""Files in and out: result lines, corpora, labelled rows, tenants, and keyed tables with last-write-wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

RESULT_SCHEMA = (
    "request_id string, sample_id string, workload string, provider string, model string, run_type string, timestamp string, tokens_in long, tokens_out long, tokens_saved long, latency_ms double, pipeline_ms double, "
    "strategies_fired array<string>, cache_tier string, qps double, rollback boolean, quality_score double, quality_method string, equivalent_paid_cost_usd double, prompt_text string, response_text string, gold_answer string, rate_limited_count int, error string"
)
QA_SCHEMA = "id string, question string, answer string, type string, supporting_titles array<string>, documents array<struct<title string, text string>>, turn_questions array<string>, _meta string"
PAIR_SCHEMA = "request_class string, input string, reference string, compressed string"


def read_results(spark: SparkSession, path: str, name_part: str | None = None) -> DataFrame:
    """Benchmark results, one JSON a line; lines that do not parse are left out, and so are files without ``name_part`` in their name."""
    rows = spark.read.schema(RESULT_SCHEMA).json(path, mode="DROPMALFORMED")
    return rows.where(F.contains(F.input_file_name(), F.lit(name_part))) if name_part else rows


def append_lines(df: DataFrame, path: str) -> None:
    """One JSON a line, added to what is there."""
    df.write.mode("append").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Multi-hop questions without the header line."""
    return spark.read.schema(QA_SCHEMA).json(path).where("_meta IS NULL").drop("_meta")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A calibration corpus: one JSON array a file."""
    return spark.read.schema(PAIR_SCHEMA).json(path, multiLine=True)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, label string").csv(path, header=True)


def read_tenants(spark: SparkSession, text: str) -> DataFrame:
    """Tenants from YAML (or JSON) text: tenant_id, requests_per_day, tokens_per_day, qps_floor, no_store, api_keys. Configuration of bounded size."""
    try:
        import yaml
    except ImportError:  # JSON is YAML too
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    rows = []
    for name, t in (found or {}).get("tenants", {}).items():
        t = t or {}
        quotas, quality = t.get("quotas") or {}, t.get("quality") or {}
        rows.append((name, quotas.get("requests_per_day"), quotas.get("tokens_per_day"), quality.get("qps_floor"), bool(t.get("no_store", False)), list(t.get("api_keys") or [])))
    return spark.createDataFrame(rows, "tenant_id string, requests_per_day long, tokens_per_day long, qps_floor double, no_store boolean, api_keys array<string>")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of both, of each key the last by ``order``: one pre-aggregated maximum instead of a sort of every key."""
    rest = [c for c in current.columns if c not in keys]
    return current.unionByName(changes).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*current.columns)
