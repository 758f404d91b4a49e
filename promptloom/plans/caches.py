"""Queries over the cache tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cache as C
from ..operators.vectors import neighbours
from ..sources.dimensions import LIFE_TIMES, life_times
from ..sources.tables import REQUESTS_SQL, literal, load, micros, request_log
from .registry import query
from .requests import conversations, sql_words

EPOCH = "CAST(epoch_us(ts) AS BIGINT)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log with at (microseconds) and key."""
    return request_log(spark, sf_dir).withColumn("at", F.expr(micros())).withColumn("key", F.col("query_key"))


@query("""WITH m AS (SELECT conv_id AS request_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
k AS (SELECT request_id, CASE WHEN request_id % 4 = 3 THEN NULL ELSE sha256((request_id % 3) || '|' || body) END AS k FROM m)
SELECT request_id, CAST(k IS NULL AS INTEGER) AS uncacheable, CASE WHEN k IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY k) END AS group_size FROM k""")
def l0_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of key groups, 0 for uncacheable requests (temperature 0.6); the hashes themselves are internal. Requests without a key join nothing,
    so they do not meet in one task."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    packed = conversations(spark, sf_dir).groupBy(F.col("conv_id").alias("request_id")).agg(rows.alias("messages"))
    heat = F.when(F.col("request_id") % 4 == 3, F.lit("0.6")).otherwise(F.lit("0.2"))
    params = F.create_map(F.lit("temperature"), heat, F.lit("stream"), (F.col("request_id") % 2).cast("string"), F.lit("n"), F.lit("1"))
    keyed = packed.select("request_id", C.exact_key(F.lit("p"), (F.col("request_id") % 3).cast("string"), params, F.col("messages")).alias("k"))
    sizes = keyed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("group_size"))
    cached = keyed.where("k IS NOT NULL").join(sizes, "k").select("request_id", F.lit(0).alias("uncacheable"), "group_size")
    return cached.unionByName(keyed.where("k IS NULL").select("request_id", F.lit(1).alias("uncacheable"), F.lit(0).cast("long").alias("group_size")))


@query(f"SELECT request_id, CAST(coalesce({EPOCH} - lag({EPOCH}) OVER (PARTITION BY tenant_id, query_key ORDER BY {EPOCH}, request_id) < 86400000000, false) AS INTEGER) AS hit FROM {REQUESTS_SQL}")
def l0_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.seen_within(timed(spark, sf_dir), F.lit(86_400_000_000)).select("request_id", "hit")


@query(f"""WITH RECURSIVE r AS (SELECT request_id, tenant_id, query_key, {EPOCH} AS stamp, row_number() OVER (PARTITION BY tenant_id, query_key ORDER BY {EPOCH}, request_id) AS n FROM {REQUESTS_SQL}),
s AS (SELECT request_id, tenant_id, query_key, n, stamp + 86400000000 AS until, 0 AS hit FROM r WHERE n = 1
UNION ALL SELECT r.request_id, r.tenant_id, r.query_key, r.n, CASE WHEN r.stamp < s.until THEN s.until ELSE r.stamp + 86400000000 END, CAST(r.stamp < s.until AS INTEGER) FROM s JOIN r ON r.tenant_id = s.tenant_id AND r.query_key = s.query_key AND r.n = s.n + 1)
SELECT request_id, hit FROM s""")
def l0_replay_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a hit does not renew."""
    return C.replay(timed(spark, sf_dir).withColumn("ttl", F.lit(86_400_000_000)))


@query(f"SELECT request_class, coalesce(ttl_seconds, 86400) AS ttl_seconds, count(*) AS n_requests FROM {REQUESTS_SQL} LEFT JOIN {literal(sorted(LIFE_TIMES.items()), ['request_class', 'ttl_seconds'])} USING (request_class) GROUP BY ALL")
def ttl_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = request_log(spark, sf_dir).groupBy("request_class").agg(F.count("*").alias("n_requests"))
    return C.life_time(counts, life_times(spark)).select("request_class", F.col("ttl_seconds").cast("long").alias("ttl_seconds"), "n_requests")


@query(f"SELECT request_id, CAST({EPOCH} + CAST(coalesce(ttl_seconds, 86400) AS BIGINT) * 1000000 > 1704844800000000 AS INTEGER) AS alive FROM {REQUESTS_SQL} LEFT JOIN {literal(sorted(LIFE_TIMES.items()), ['request_class', 'ttl_seconds'])} USING (request_class)")
def ttl_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries still alive on 2024-01-10."""
    rows = C.life_time(timed(spark, sf_dir), life_times(spark))
    return rows.select("request_id", (F.col("at") + F.col("ttl_seconds") * 1_000_000 > 1_704_844_800_000_000).cast("int").alias("alive"))


@query("""SELECT conv_id AS request_id, sha256('t' || (conv_id % 5) || '|p|m||' || left(sha256(coalesce(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (WHERE turn < last), '')), 16)) AS namespace
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id""")
def l1_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(":"), F.col("text")).alias("m"))))
    packed = conversations(spark, sf_dir).groupBy(F.col("conv_id").alias("request_id")).agg(rows.alias("r"))
    prior = F.array_join(F.transform(F.slice("r", 1, F.size("r") - 1), lambda x: x["m"]), "|")
    digest = F.left(F.sha2(prior, 256), F.lit(16))
    return packed.select("request_id", C.namespace(F.concat(F.lit("t"), F.col("request_id") % 5), F.lit("p"), F.lit("m"), F.lit(""), digest).alias("namespace"))


@query("""SELECT conv_id AS request_id, sha256(right(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn < last), ''), 1024) || chr(10) || max(text) FILTER (WHERE turn = last)) AS query_sha256
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id""")
def l1_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    packed = conversations(spark, sf_dir).groupBy(F.col("conv_id").alias("request_id")).agg(rows.alias("r"))
    texts = F.transform("r", lambda x: x["text"])
    return packed.select("request_id", F.sha2(C.query_text(F.array_join(F.slice(texts, 1, F.size(texts) - 1), "\n"), F.element_at(texts, -1)), 256).alias("query_sha256"))


@query("""WITH a AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))) AS c FROM a q JOIN a d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, rank, round(c, 4) + 0.0 AS cosine FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest in its namespace of every hundredth vector."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("namespace"), "embedding")
    return neighbours(rows, rows.where("vec_id % 100 = 0"), k=5).select("query_id", "vec_id", "rank", (F.round("cosine", 4) + 0.0).alias("cosine"))


NEXT = "(SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)"


@query(f"SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT conv_id, turn, list_distinct({sql_words('lower(text)')}) AS a, list_distinct({sql_words('lower(next)')}) AS b FROM {NEXT} WHERE next IS NOT NULL)")
def rerank_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations(spark, sf_dir).withColumn("next", F.lead("text").over(order)).where("next IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(C.token_jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


@query(f"""WITH b AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS a, regexp_extract_all(lower(next), '[a-z]+') AS b FROM {NEXT} WHERE next IS NOT NULL),
t AS (SELECT conv_id, turn, w, sum(x) AS x, sum(y) AS y FROM (SELECT conv_id, turn, unnest(a) AS w, 1 AS x, 0 AS y FROM b UNION ALL SELECT conv_id, turn, unnest(b), 0, 1 FROM b) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN sum(x) = 0 OR sum(y) = 0 THEN 0.0 ELSE sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) END, 6) AS cosine FROM t GROUP BY ALL""")
def bow_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions import arrow as P

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations(spark, sf_dir).withColumn("next", F.lead("text").over(order)).where("next IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(P.text_cosine("text", "next"), 6).alias("cosine"))


@query(f"""SELECT request_id, CAST(qps_milli >= 950 AND latency_ms >= 300 AND (query_key % 5 = 0 OR query_key % 7 = 0) AS INTEGER) AS accepted FROM {REQUESTS_SQL}""")
def l1_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from the log; the cached answer has two numbers and the new request up to one more."""
    key = F.col("query_key")
    new = F.when(key % 5 == 0, F.array(F.lit("1"))).when(key % 7 == 0, F.array(F.lit("2"), F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("3")))
    cross = F.when(F.col("latency_ms") >= 300, 0.9).otherwise(0.8)
    rows = request_log(spark, sf_dir)
    return rows.select("request_id", C.accept(F.col("qps_milli") / 1000, F.lit(0.95), cross, F.array(F.lit("1"), F.lit("2")), new).cast("int").alias("accepted"))


@query(f"""SELECT request_id AS entry_id FROM (SELECT request_id, row_number() OVER (PARTITION BY tenant_id ORDER BY query_key + tokens_saved * 0.0001 DESC, request_id) AS n FROM {REQUESTS_SQL}) WHERE n <= 50""")
def lruk_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).select(F.col("request_id").alias("entry_id"), F.col("tenant_id").alias("namespace"), F.col("query_key").alias("last_access_1"), "tokens_saved")
    return C.evict(rows, 50).select("entry_id")


@query(f"""WITH p AS (SELECT tenant_id || ':' || query_key AS key, min(request_id) AS a, max(request_id) AS b FROM {REQUESTS_SQL} GROUP BY ALL) SELECT key FROM p WHERE a % 50 <> 0 AND b % 50 <> 0""")
def l2_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that depend on their first and last request; every fiftieth has changed."""
    log = request_log(spark, sf_dir)
    plans = log.groupBy(F.concat("tenant_id", F.lit(":"), "query_key").alias("key")).agg(F.array(F.min("request_id"), F.max("request_id")).alias("depends_on"))
    return C.invalidate(plans, log.where("request_id % 50 = 0").select(F.col("request_id").alias("doc"))).select("key")


@query(f"""WITH p AS (SELECT tenant_id, query_key, arg_max(request_id, request_id) AS plan FROM {REQUESTS_SQL} WHERE request_id % 3 = 0 GROUP BY ALL) SELECT r.request_id, p.plan FROM {REQUESTS_SQL} r LEFT JOIN p USING (tenant_id, query_key)""")
def l2_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last plan stored for a template and tenant."""
    log = request_log(spark, sf_dir)
    plans = log.where("request_id % 3 = 0").groupBy("tenant_id", "query_key").agg(F.max("request_id").alias("plan"))
    return log.join(plans, ["tenant_id", "query_key"], "left").select("request_id", "plan")
