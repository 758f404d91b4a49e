"""Queries over benchmark results and scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import benchmarks as B
from ..sources.dimensions import PRICES, prices
from ..sources.tables import choose, literal, load
from .registry import query
from .requests import conversations, sql_word, sql_words
from ..functions import text as T

WORKLOADS = ["rag", "agent", "chat", "faq"]
RESULTS = {
    "run_type": choose("event_id", ["baseline", "optimised"]), "provider": choose("event_id % 7", ["groq", "mistral", "cohere"]), "workload": choose("event_id % 13", WORKLOADS), "sample_id": "event_id % 150", "seq": "event_id",
    "tokens_in": "100 + (event_id * 37) % 900", "tokens_saved": "CASE WHEN event_id % 2 = 1 THEN (event_id * 53) % 400 ELSE 0 END", "latency_ms": "(event_id * 131) % 700", "cost_micros": "(event_id * 17) % 5000",
    "quality_milli": "700 + (event_id * 29) % 300", "cache_tier": choose("event_id % 5", ["l0", None, "miss", "l1", None]), "error": "CASE WHEN event_id % 31 = 0 THEN 'timeout' END",
}
RESULTS_SQL = f"(SELECT {', '.join(f'{e} AS {n}' for n, e in RESULTS.items())} FROM events)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in RESULTS.items()))


@query(f"SELECT run_type, provider, workload, sample_id, seq, tokens_saved FROM (SELECT *, row_number() OVER (PARTITION BY run_type, provider, workload, sample_id ORDER BY seq DESC) AS n FROM {RESULTS_SQL}) WHERE n = 1")
def bench_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest(results(spark, sf_dir), ["run_type", "provider", "workload", "sample_id"], "seq").select("run_type", "provider", "workload", "sample_id", "seq", "tokens_saved")


@query(f"SELECT seq, round(CASE WHEN tokens_in <= 0 THEN 0.0 ELSE tokens_saved / (tokens_in + tokens_saved) END, 6) AS reduction FROM {RESULTS_SQL}")
def token_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("seq", F.round(B.reduction(F.col("tokens_saved"), F.col("tokens_in")), 6).alias("reduction"))


STATS_SQL = f"""SELECT workload, provider, count(*) FILTER (WHERE run_type = 'baseline') AS n_baseline, count(*) FILTER (WHERE run_type = 'optimised') AS n_run,
round(sum(tokens_saved * 1000000 // (tokens_in + tokens_saved)) FILTER (WHERE run_type = 'optimised') / nullif(count(*) FILTER (WHERE run_type = 'optimised'), 0), 4) AS reduction_ppm,
round(sum(latency_ms) FILTER (WHERE run_type = 'baseline') / nullif(count(*) FILTER (WHERE run_type = 'baseline'), 0), 4) AS latency_baseline,
round(sum(latency_ms) FILTER (WHERE run_type = 'optimised') / nullif(count(*) FILTER (WHERE run_type = 'optimised'), 0), 4) AS latency_run,
round(count(*) FILTER (WHERE run_type = 'optimised' AND cache_tier IN ('l0', 'l1', 'l2')) / nullif(count(*) FILTER (WHERE run_type = 'optimised'), 0), 4) AS cache_hit_rate,
CAST(greatest(0, coalesce(sum(cost_micros) FILTER (WHERE run_type = 'baseline'), 0) - coalesce(sum(cost_micros) FILTER (WHERE run_type = 'optimised'), 0)) AS BIGINT) AS saved_micros
FROM {RESULTS_SQL} WHERE error IS NULL GROUP BY ALL"""


@query(STATS_SQL)
def bench_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.workload_stats(results(spark, sf_dir))


@query(f"SELECT count(DISTINCT provider) AS n_providers, count(DISTINCT workload) AS n_workloads, CAST(sum(saved_micros) AS BIGINT) AS saved_micros, CAST(sum(n_run) AS BIGINT) AS n_run FROM ({STATS_SQL})")
def bench_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.workload_stats(results(spark, sf_dir)).agg(F.count_distinct("provider").alias("n_providers"), F.count_distinct("workload").alias("n_workloads"), F.sum("saved_micros").alias("saved_micros"), F.sum("n_run").alias("n_run"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).where("run_type = 'optimised' AND error IS NULL")
    return B.bootstrap(rows.select("workload", F.col("seq").alias("id"), (F.col("quality_milli") / 1000).alias("value")), ["workload"], 200)


CARDS = f"(SELECT run_type, provider, workload, sample_id, arg_max(tokens_saved, seq) AS tokens_saved, arg_max(quality_milli, seq) AS quality_milli, arg_max(latency_ms, seq) AS latency_ms FROM {RESULTS_SQL} WHERE error IS NULL GROUP BY ALL)"


@query(f"""WITH c AS {CARDS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY workload, provider ORDER BY tokens_saved DESC, quality_milli, sample_id) AS INTEGER) AS place FROM c WHERE run_type = 'optimised')
SELECT r.workload, r.provider, r.sample_id, place, r.tokens_saved, b.latency_ms AS baseline_latency FROM r LEFT JOIN c b ON b.run_type = 'baseline' AND b.workload = r.workload AND b.provider = r.provider AND b.sample_id = r.sample_id WHERE place <= 15""")
def bench_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.latest(results(spark, sf_dir).where("error IS NULL"), ["run_type", "provider", "workload", "sample_id"], "seq")
    return B.sample_cards(rows)


@query(f"SELECT provider, v AS tokens_per_day, round((v * 22.5 * input_price + v * 7.5 * output_price) / 1e6, 4) AS cost, round((v * 22.5 * input_price + v * 7.5 * output_price) / 1e6 * 0.75, 4) AS cost_saved FROM {literal(PRICES, ['provider', 'input_price', 'output_price', 'd'])}, (SELECT unnest([100000, 1000000, 10000000, 100000000]) AS v)")
def scale_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scale_table(prices(spark), 0.25)


@query(f"SELECT workload, provider, count(*) FILTER (WHERE error IS NULL) AS n_ok FROM {RESULTS_SQL} GROUP BY ALL HAVING count(*) FILTER (WHERE error IS NULL) < 800")
def shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("workload", "provider").agg(F.count_if(F.col("error").isNull()).alias("n_ok")).where("n_ok < 800")


PAIR = "(SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS a, regexp_replace(next, '[^\\x00-\\x7F]', 'x', 'g') AS b FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns as response and reference, in ASCII."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "x")
    return conversations(spark, sf_dir).withColumn("next", F.lead("text").over(order)).where("next IS NOT NULL").select("conv_id", "turn", plain("text").alias("a"), plain("next").alias("b"))


def _answer(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g')"
    return sql_words(bare)


@query(f"SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = 0 AND len(g) = 0 AS INTEGER) ELSE 2.0 * len(list_intersect(list_distinct(p), list_distinct(g))) / (len(p) + len(g)) END, 6) AS f1 FROM (SELECT conv_id, turn, {_answer('a')} AS p, {_answer('b')} AS g FROM {PAIR})")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(B.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


BIGRAMS = "CASE WHEN len({0}) >= 2 THEN list_distinct(list_transform({0}[1:len({0}) - 1], lambda w, i: w || ' ' || {0}[i + 1])) ELSE list_distinct({0}) END"


@query(f"""SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard
FROM (SELECT conv_id, turn, {BIGRAMS.format('p')} AS x, {BIGRAMS.format('g')} AS y FROM (SELECT conv_id, turn, {_answer('a')} AS p, {_answer('b')} AS g FROM {PAIR}))""")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(B.bigram_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"""SELECT conv_id, turn, CAST(greatest(1, len({sql_words('a')})) / greatest(1, len({sql_words('b')})) BETWEEN 0.5 AND 2.0 AS DOUBLE) AS length_ok, CAST({sql_word('a', T.REFUSALS)} = {sql_word('b', T.REFUSALS)} AS DOUBLE) AS refusal_match,
(CAST(contains(lower(a), 'the') AS INTEGER) + CAST(contains(lower(a), 'zzz') AS INTEGER)) / 2.0 AS entities FROM {PAIR}""")
def judge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("conv_id", "turn", B.length_ok(a, b).alias("length_ok"), B.refusal_match(a, b).alias("refusal_match"), B.entity_coverage(a, F.array(F.lit("The"), F.lit("ZZZ"))).alias("entities"))


JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1e0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@query(f"""WITH t AS (SELECT conv_id, turn, a, b, {_answer('a')} AS p, {_answer('b')} AS g, {_answer('left(b, 40)')} AS o FROM {PAIR}),
x AS (SELECT *, {BIGRAMS.format('p')} AS x, {BIGRAMS.format('g')} AS y FROM t),
j AS (SELECT *, {JACCARD.format('x', 'y')} AS j, CAST(greatest(1, len({sql_words('a')})) / greatest(1, len({sql_words('b')})) BETWEEN 0.5 AND 2.0 AS INTEGER) AS length_ok, CAST({sql_word('a', T.REFUSALS)} = {sql_word('b', T.REFUSALS)} AS INTEGER) AS refuse FROM x),
c AS (SELECT *, 0.6e0 * j + 0.2e0 * length_ok + 0.2e0 * refuse AS chat,
 CASE WHEN len(p) = 0 OR len(o) = 0 THEN CAST(len(p) = 0 AND len(o) = 0 AS INTEGER) ELSE 2e0 * len(list_intersect(list_distinct(p), list_distinct(o))) / (len(p) + len(o)) END AS f1 FROM j)
SELECT conv_id, turn, list_extract({WORKLOADS}, CAST(conv_id % 4 + 1 AS INTEGER)) AS workload, round(CASE conv_id % 4
 WHEN 0 THEN CASE WHEN turn % 2 = 0 THEN greatest(CAST(array_to_string(p, ' ') = array_to_string(o, ' ') AS INTEGER), f1 * 0.9e0, chat * 0.95e0) ELSE chat END
 WHEN 1 THEN 0.5e0 * CAST(contains(lower(a), 'the') AS INTEGER) + 0.35e0 * j + 0.15e0 * length_ok WHEN 2 THEN chat
 ELSE CASE WHEN turn % 3 = 0 THEN CASE WHEN trim(a) = trim(b) THEN 1e0 ELSE 0.7e0 END ELSE j END END, 6) AS score FROM c""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, WORKLOADS)), (F.col("conv_id") % 4 + 1).cast("int"))
    gold = F.when(F.col("turn") % 2 == 0, F.left("b", F.lit(40)))
    score = B.workload_score(kind, F.col("a"), F.col("b"), gold, F.array(F.lit("the")), F.col("turn") % 3 == 0)
    return pairs(spark, sf_dir).select("conv_id", "turn", kind.alias("workload"), F.round(score, 6).alias("score"))
