"""Queries over signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrow as P, text as T
from ..operators import segments as S, signals as G
from ..sources.tables import load
from .registry import query
from .requests import SEGMENTS_SQL, conversations, sql_strip, sql_tokens, sql_words


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens_div4 FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    quarter = F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", T.token_estimate(text).alias("tokens"), quarter.alias("tokens_div4"))


@query(f"SELECT request_id, CAST(sum(token_count) AS BIGINT) AS request_tokens, count(*) AS n_segments FROM {SEGMENTS_SQL} GROUP BY request_id")
def request_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments(conversations(spark, sf_dir)).groupBy("request_id").agg(F.sum("token_count").alias("request_tokens"), F.count("*").alias("n_segments"))


@query("""SELECT conv_id AS request_id, turn AS seg_idx, CAST(CASE WHEN length(text) < 5 THEN 1 ELSE len(list_distinct(list_transform(generate_series(1, length(text) - 4), lambda i: substr(lower(text), i, 5)))) END AS BIGINT) AS n_shingles FROM conversations""")
def shingle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), P.shingle_count("text").alias("n_shingles"))


@query()
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are signed once."""
    texts = conversations(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), "text")
    return texts.select("request_id", "seg_idx", F.sha2(F.to_json(P.minhash("text")), 256).alias("signature_sha256"))


@query()
def minhash_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of neighbouring turns."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    signed = conversations(spark, sf_dir).select("conv_id", "turn", P.minhash("text").alias("sig"))
    return signed.withColumn("before", F.lag("sig").over(order)).where("before IS NOT NULL").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), P.jaccard_estimate(F.col("sig"), F.col("before")).alias("jaccard"))


@query()
def redundancy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.redundancy(S.segments(conversations(spark, sf_dir)))


@query()
def semantic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", P.semantic_density("text").alias("semantic_density"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS ws FROM documents)
SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_distinct(ws)) / len(ws) END, 6) AS unique_word_ratio FROM w""")
def unique_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b(\w+)\b"), 1)
    ratio = F.when(F.size("ws") == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct("ws")) / F.size("ws"))
    return load(spark, sf_dir, "documents").select("doc_id", found.alias("ws")).select("doc_id", F.round(ratio, 6).alias("unique_word_ratio"))


@query(f"SELECT request_id, round(sum(CASE WHEN segment_type = 'SYSTEM_INSTRUCTION' THEN token_count ELSE 0 END) / greatest(sum(token_count), 1), 6) AS instruction_ratio FROM {SEGMENTS_SQL} GROUP BY request_id")
def instruction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.sum(F.when(F.col("segment_type") == "SYSTEM_INSTRUCTION", F.col("token_count")).otherwise(0)) / F.greatest(F.sum("token_count"), F.lit(1))
    return S.segments(conversations(spark, sf_dir)).groupBy("request_id").agg(F.round(share, 6).alias("instruction_ratio"))


@query("""SELECT conv_id AS request_id, count(*) FILTER (WHERE role = 'user' AND next = 'assistant') AS history_depth
FROM (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role <> 'system') GROUP BY conv_id""")
def history_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.history_depth(conversations(spark, sf_dir))


@query(f"""WITH s AS {SEGMENTS_SQL}, m AS (SELECT request_id, max(seg_idx) AS last FROM s GROUP BY request_id)
SELECT request_id, CAST(sum(CASE WHEN segment_type = 'ASSISTANT_TURN' AND seg_idx < last - 2 THEN token_count ELSE 0 END) AS BIGINT) AS stale_mass FROM s JOIN m USING (request_id) GROUP BY request_id""")
def stale_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On assistant turns, two messages back: the table has no tool results."""
    return G.stale_mass(S.segments(conversations(spark, sf_dir)), "ASSISTANT_TURN", 2)


@query()
def prefix_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = conversations(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("prefix"), F.min_by("role", "turn").alias("template"))
    rows = firsts.select(F.col("conv_id").alias("request_id"), F.concat(F.lit("t"), F.col("conv_id") % 50).alias("tenant_id"), "template", F.col("conv_id").alias("ts"), "prefix")
    return G.prefix_span(rows)


@query()
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a request."""
    conv = conversations(spark, sf_dir)
    segs = S.segments(conv)
    tokens = segs.groupBy("request_id").agg(F.sum("token_count").alias("token_count"), (F.sum(F.when(F.col("role") == "system", F.col("token_count")).otherwise(0)) / F.greatest(F.sum("token_count"), F.lit(1))).alias("instruction_ratio"))
    density = S.joined_texts(segs).select("request_id", P.semantic_density("full_text").alias("semantic_density"))
    return tokens.join(G.history_depth(conv), "request_id", "left").join(G.redundancy(segs), "request_id").join(density, "request_id").join(S.template_signature(segs), "request_id")


@query(f"SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws)) / len(ws) END, 6) AS ttr FROM (SELECT doc_id, {sql_words(sql_strip('lower(text)'))} AS ws FROM documents)")
def ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", T.words(F.lower("text")).alias("ws"))
    return rows.select("doc_id", F.round(F.when(F.size("ws") == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct("ws")) / F.size("ws")), 6).alias("ttr"))


def _verbs_sql() -> str:
    out = []
    for name, lexicon in G.VERBS.items():
        single = ", ".join(f"'{v}'" for v in lexicon if " " not in v)
        phrases = "".join(f" + len(regexp_extract_all(low, '{v}'))" for v in lexicon if " " in v)
        out.append(f"CAST(len(list_filter(ws, lambda w: w IN ({single}))){phrases} AS BIGINT) AS n_{name.lower()}")
    return f"SELECT conv_id AS request_id, turn AS seg_idx, {', '.join(out)} FROM (SELECT conv_id, turn, lower(text) AS low, {sql_words(sql_strip('lower(text)'))} AS ws FROM conversations)"


@query(_verbs_sql())
def verb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), *G.verb_counts(F.col("text")))
