"""Rule classes, linear classes and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..sources.dimensions import RESTRICTED_FLOOR

# Fixed patterns, matched as whole words in any case.
SUMMARISE = r"summarize|summarise|tl;?dr|summary\s+of"
SCHEMA = r"\"type\"\s*:|\"properties\"\s*:|\$schema"
EXTRACT = r"extract|parse|find\s+all|list\s+all|what\s+is\s+the"
MATH = r"solve|calculate|compute|proof|prove|how\s+many|what\s+is\s+[0-9]"
CODE = r"write\s+a\s+function|implement|debug|fix\s+this\s+code"
CLASSIFY = r"classify|categorize|categorise|which\s+category|label|is\s+this\s+a|sentiment"
CREATE = r"write\s+a|draft|compose|create\s+a"
CREATIVE = r"story|poem|blog|email|essay|creative"
FACTUAL = r"write\s+a|draft|compose|generate\s+a\s+report|write\s+a\s+report"
SHORT_TOKENS = 200


def simple_class() -> Column:
    """Class of a request without tools whose query fires no rule: by whether it has a system segment (an aggregate)."""
    return F.when(F.bool_or(F.col("segment_type") == "SYSTEM_INSTRUCTION"), "GENERATION_FACTUAL").otherwise("CHAT_OPEN")


def fired_rules() -> Column:
    """The rules that fire, best first, over columns query, has_doc, has_system, system_text, has_tools, has_tool_result."""
    q = F.col("query")
    tokens = F.greatest(F.lit(1), F.floor(F.length(q) / F.lit(T.CHARS_PER_TOKEN)))
    rules = [
        (F.col("has_tools"), "AGENT_TOOL_LOOP", 0.95),
        (F.col("has_tool_result"), "AGENT_TOOL_LOOP", 0.90),
        (T.has_word(q, SUMMARISE) & F.col("has_doc"), "SUMMARIZATION", 0.90),
        (F.col("system_text").rlike(f"(?i)(?:{SCHEMA})"), "EXTRACTION", 0.88),
        (T.has_word(q, EXTRACT) & F.col("has_doc"), "EXTRACTION", 0.85),
        (T.has_word(q, f"{MATH}|{CODE}"), "REASONING", 0.85),
        (T.has_word(q, CLASSIFY) & (tokens < SHORT_TOKENS), "CLASSIFICATION_SHORT", 0.87),
        (T.has_word(q, CREATE) & T.has_word(q, CREATIVE), "GENERATION_CREATIVE", 0.82),
        (T.has_word(q, FACTUAL) & ~T.has_word(q, CREATIVE), "GENERATION_FACTUAL", 0.80),
    ]
    entry = lambda c, s: F.struct((-F.lit(s)).alias("neg"), F.lit(c).alias("cls"))
    fired = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), entry(c, s)) for test, c, s in rules)), lambda x: x.isNotNull())
    fallback = F.when(F.col("has_system"), F.array(entry("GENERATION_FACTUAL", 0.72))).otherwise(F.array(entry("CHAT_OPEN", 0.65)))
    return F.when(F.size(fired) > 0, F.array_sort(fired)).otherwise(fallback)


def classify(requests: DataFrame) -> DataFrame:
    """request_id, primary_class, confidence, second_class (the first, if there is no other), n_classes, ambiguous."""
    rows = requests.select("request_id", fired_rules().alias("fired"))
    kinds = F.array_distinct(F.transform("fired", lambda x: x["cls"]))
    confidence = -F.col("fired")[0]["neg"]
    return rows.select("request_id", kinds[0].alias("primary_class"), confidence.alias("confidence"), F.coalesce(F.get(kinds, F.lit(1)), kinds[0]).alias("second_class"), F.size(kinds).alias("n_classes"), (confidence < 0.6).cast("int").alias("ambiguous"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def linear_softmax(rows: DataFrame, vector: str, weights: list[list[float]], bias: list[float], names: list[str]) -> DataFrame:
    """``rows`` with the class of the greatest logit and its softmax probability."""
    logits = F.array(*(dot(F.col(vector), F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, bias, strict=True)))
    top = F.array_max("logits")
    total = F.aggregate(F.transform("logits", lambda z: F.exp(z - top)), F.lit(0.0), lambda s, v: s + v)
    named = F.array(*map(F.lit, names))
    return rows.withColumn("logits", logits).withColumn("predicted", F.element_at(named, F.array_position("logits", top).cast("int"))).withColumn("probability", 1 / total).drop("logits")


def pool(vector: Column, size: int) -> Column:
    """Means of runs of ``size`` components."""
    return F.transform(F.sequence(F.lit(0), (F.size(vector) / size - 1).cast("int")), lambda k: F.aggregate(F.slice(vector, k * size + 1, size), F.lit(0.0), lambda s, v: s + v.cast("double")) / size)


def ambiguous_routes(routes: DataFrame) -> DataFrame:
    """Intersection of the routes of every two classes a < b."""
    side = lambda n: routes.select("strategy", *(F.col(c).alias(f"{c}_{n}") for c in ("request_class", "status", "floor", "l1_allowed", "l1_tau")))
    both = side("a").join(side("b"), "strategy").where("request_class_a < request_class_b")
    either = lambda s: (F.col("status_a") == s) | (F.col("status_b") == s)
    status = F.when(either("DISABLED"), "DISABLED").when(either("RESTRICTED"), "RESTRICTED").otherwise("ALLOWED")
    floor = F.greatest(F.coalesce("floor_a", F.lit(RESTRICTED_FLOOR)), F.coalesce("floor_b", F.lit(RESTRICTED_FLOOR)))
    l1 = F.least("l1_allowed_a", "l1_allowed_b")
    return both.select("request_class_a", "request_class_b", "strategy", status.alias("status"), F.when(status == "RESTRICTED", floor).alias("floor"), l1.alias("l1_allowed"), F.when(l1 == 1, F.greatest("l1_tau_a", "l1_tau_b")).alias("l1_tau"))


def tighten(settings: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenant overrides that only ever tighten: the greater floor, the more careful mode."""
    rank = F.create_map(*(F.lit(x) for pair in (("optimize", 0), ("observe_only", 1), ("off", 2)) for x in pair))
    mode = F.when(F.coalesce(rank[F.col("t.mode")], F.lit(0)) > rank[F.col("s.mode")], F.col("t.mode")).otherwise(F.col("s.mode"))
    return tenants.alias("t").crossJoin(F.broadcast(settings.alias("s"))).select("t.tenant_id", F.greatest(F.col("s.qps_floor"), F.coalesce("t.qps_floor", F.col("s.qps_floor"))).alias("qps_floor"), mode.alias("mode"))


def train_linear(rows: DataFrame, vector: str, label: str, iterations: int = 20):
    """Multinomial logistic regression, fitted on the cluster."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=iterations, regParam=0.01, family="multinomial").fit(data)
