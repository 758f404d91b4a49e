"""Queries over classes and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import classify as C
from ..sources.dimensions import ROUTING_COLUMNS, routing, routing_rows
from ..sources.tables import CLASSES, literal, load
from .registry import query
from .requests import sql_word

REQUEST_ROWS = [
    (1, "summarize this for me", 1, 0, "", 0, 0), (2, "please extract the names", 1, 0, "", 0, 0), (3, "solve x + 1 = 2", 0, 0, "", 0, 0), (4, "classify this text", 0, 1, "", 0, 0), (5, "write a poem about rain", 0, 0, "", 0, 0),
    (6, "write a report on rain", 0, 0, "", 0, 0), (7, "hello", 0, 1, "be kind", 0, 0), (8, "hello", 0, 0, "", 0, 0), (9, "solve it", 0, 0, "", 1, 0), (10, "summarize", 0, 1, 'answer with {"type": "object"}', 0, 1),
    (11, "classify " + "x" * 900, 0, 0, "", 0, 0), (12, "implement and classify and draft a story", 0, 0, "", 0, 0), (13, "unsolved", 0, 0, "", 0, 0), (14, "", 0, 0, "", 0, 0),
]
REQUEST_COLUMNS = ["request_id", "query", "has_doc", "has_system", "system_text", "has_tools", "has_tool_result"]
REQUEST_SQL = literal(REQUEST_ROWS, REQUEST_COLUMNS)
ROUTING_SQL = literal(routing_rows(), [c.split()[0] for c in ROUTING_COLUMNS.split(", ")])


def _request_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows above, and every conversation's last user message."""
    fixed = spark.createDataFrame(REQUEST_ROWS, "request_id long, query string, has_doc int, has_system int, system_text string, has_tools int, has_tool_result int")
    conv = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("query"), F.max((F.col("role") == "system").cast("int")).alias("has_system"))
    rows = fixed.unionByName(conv.select((F.col("conv_id") + 1000).alias("request_id"), "query", F.lit(0).alias("has_doc"), "has_system", F.lit("").alias("system_text"), F.lit(0).alias("has_tools"), F.lit(0).alias("has_tool_result")))
    return rows.select("request_id", "query", "system_text", *((F.col(c) == 1).alias(c) for c in ("has_doc", "has_system", "has_tools", "has_tool_result")))


def _rules_sql(last: str) -> str:
    q = lambda p: sql_word("query", p)
    rules = [
        ("has_tools = 1", "AGENT_TOOL_LOOP", 0.95), ("has_tool_result = 1", "AGENT_TOOL_LOOP", 0.90), (f"{q(C.SUMMARISE)} AND has_doc = 1", "SUMMARIZATION", 0.90),
        (f"regexp_matches(system_text, '(?i)(?:{C.SCHEMA})')", "EXTRACTION", 0.88), (f"{q(C.EXTRACT)} AND has_doc = 1", "EXTRACTION", 0.85), (q(f"{C.MATH}|{C.CODE}"), "REASONING", 0.85),
        (f"{q(C.CLASSIFY)} AND greatest(1, floor(length(query) / 3.8)) < 200", "CLASSIFICATION_SHORT", 0.87), (f"{q(C.CREATE)} AND {q(C.CREATIVE)}", "GENERATION_CREATIVE", 0.82), (f"{q(C.FACTUAL)} AND NOT {q(C.CREATIVE)}", "GENERATION_FACTUAL", 0.80),
    ]
    fired = " UNION ALL ".join(f"SELECT request_id, '{c}' AS cls, CAST({s} AS DOUBLE) AS score FROM r WHERE {test}" for test, c, s in rules)
    return f"""WITH c AS (SELECT conv_id + 1000 AS request_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS query, 0 AS has_doc, CAST(max(CAST(role = 'system' AS INTEGER)) AS INTEGER) AS has_system, '' AS system_text, 0 AS has_tools, 0 AS has_tool_result FROM conversations GROUP BY conv_id),
r AS (SELECT * FROM {REQUEST_SQL} UNION ALL SELECT * FROM c), f AS ({fired}),
e AS (SELECT * FROM f UNION ALL SELECT request_id, CASE WHEN has_system = 1 THEN 'GENERATION_FACTUAL' ELSE 'CHAT_OPEN' END, CASE WHEN has_system = 1 THEN 0.72 ELSE 0.65 END FROM r WHERE request_id NOT IN (SELECT request_id FROM f)),
b AS (SELECT request_id, cls, max(score) AS score FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, cls) AS place FROM b)
{last}"""


@query(_rules_sql("SELECT request_id, cls AS primary_class, score AS confidence, CAST(score < 0.6 AS INTEGER) AS ambiguous FROM o WHERE place = 1"))
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(_request_input(spark, sf_dir)).select("request_id", "primary_class", "confidence", "ambiguous")


@query(_rules_sql("SELECT request_id, max(cls) FILTER (WHERE place = 1) AS primary_class, coalesce(max(cls) FILTER (WHERE place = 2), max(cls) FILTER (WHERE place = 1)) AS second_class, CAST(count(*) AS INTEGER) AS n_classes FROM o GROUP BY request_id"))
def classify_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(_request_input(spark, sf_dir)).select("request_id", "primary_class", "second_class", "n_classes")


WEIGHTS = [[((7 * k + 3 * j) % 11 - 5) / 5 for j in range(64)] for k in range(8)]
BIAS = [0.1 * k for k in range(8)]


@query(f"""WITH z AS (SELECT vec_id, [{', '.join(f"list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), CAST({w} AS DOUBLE[])) + {b}" for w, b in zip(WEIGHTS, BIAS, strict=True))}] AS z FROM embeddings)
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted, round(1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 4) AS probability FROM z""")
def linear_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.linear_softmax(load(spark, sf_dir, "embeddings"), "embedding", WEIGHTS, BIAS, [str(k) for k in range(8)])
    return rows.select("vec_id", F.col("predicted").cast("int").alias("predicted"), F.round("probability", 4).alias("probability"))


@query()
def train_stage_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    model = C.train_linear(rows, "embedding", "label")
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(rows.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("n_right"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS part, round((CAST(embedding[4 * i + 1] AS DOUBLE) + embedding[4 * i + 2] + embedding[4 * i + 3] + embedding[4 * i + 4]) / 4, 4) + 0.0 AS pooled FROM embeddings, generate_series(0, 15) AS g(i)")
def embedding_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.pool(F.col("embedding"), 4)).alias("part", "pooled")).select("vec_id", "part", (F.round("pooled", 4) + 0.0).alias("pooled"))


@query(f"SELECT l.request_class, strategy, status, floor, l1_allowed, l1_tau, count(*) AS n_requests FROM (SELECT CASE event_id % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{c}{chr(39)}' for k, c in enumerate(CLASSES))} END AS request_class FROM events) l JOIN {ROUTING_SQL} d ON d.request_class = l.request_class GROUP BY ALL", name="routing")
def routing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are counted by class before the routes multiply them."""
    from ..sources.tables import request_log

    counts = request_log(spark, sf_dir).groupBy("request_class").agg(F.count("*").alias("n_requests"))
    return counts.join(F.broadcast(routing(spark)), "request_class")


@query(f"""WITH d AS {ROUTING_SQL} SELECT a.request_class AS request_class_a, b.request_class AS request_class_b, a.strategy,
CASE WHEN 'DISABLED' IN (a.status, b.status) THEN 'DISABLED' WHEN 'RESTRICTED' IN (a.status, b.status) THEN 'RESTRICTED' ELSE 'ALLOWED' END AS status,
CASE WHEN 'DISABLED' NOT IN (a.status, b.status) AND 'RESTRICTED' IN (a.status, b.status) THEN greatest(coalesce(a.floor, 0.97), coalesce(b.floor, 0.97)) END AS floor,
least(a.l1_allowed, b.l1_allowed) AS l1_allowed, CASE WHEN least(a.l1_allowed, b.l1_allowed) = 1 THEN greatest(a.l1_tau, b.l1_tau) END AS l1_tau
FROM d a JOIN d b ON a.strategy = b.strategy AND a.request_class < b.request_class""")
def routing_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ambiguous_routes(routing(spark))


@query("""SELECT 'tenant' || (user_id % 20) AS tenant_id, CAST(max(greatest(0.98, CASE WHEN user_id % 3 = 0 THEN 0.9 + (user_id % 10) / 100.0 ELSE 0.98 END)) AS DOUBLE) AS qps_floor,
CASE WHEN bool_or(user_id % 7 = 0) THEN 'off' ELSE 'observe_only' END AS mode FROM events GROUP BY 1""")
def tenant_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    tenants = load(spark, sf_dir, "events").groupBy(F.concat(F.lit("tenant"), user % 20).alias("tenant_id")).agg(F.max(F.when(user % 3 == 0, 0.9 + (user % 10) / 100)).alias("qps_floor"), F.when(F.bool_or(user % 7 == 0), "off").otherwise("optimize").alias("mode"))
    return C.tighten(spark.createDataFrame([(0.98, "observe_only")], "qps_floor double, mode string"), tenants)
