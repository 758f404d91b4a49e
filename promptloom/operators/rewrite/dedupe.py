"""S1: duplicate segments, by equal hash and by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions import arrow as P, text as T
from ..signals import near_pairs

EXCLUDED = ["TOOL_SCHEMA", "CODE_BLOCK"]
CANDIDATE, VERIFIED = 0.55, 0.92


def eligible(segs: DataFrame) -> DataFrame:
    return segs.where(~F.col("segment_type").isin(EXCLUDED))


def similar_pairs(segs: DataFrame, candidate: float = CANDIDATE, verified: float = VERIFIED) -> DataFrame:
    """(request_id, segment_type, a, b, jaccard, cosine): candidates by MinHash, verified by the cosine of their bags of words."""
    pairs = near_pairs(eligible(segs), candidate)
    texts = lambda n: segs.select("request_id", F.col("seg_idx").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(texts("a"), ["request_id", "a"]).join(texts("b"), ["request_id", "b"])
    return both.withColumn("cosine", P.text_cosine("text_a", "text_b")).drop("text_a", "text_b").where(F.col("cosine") >= verified)


def clusters(segs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(request_id, seg_idx, cluster): the smallest index that pairs connect a segment to.

    Labels go along the pairs and then jump to their label's label until nothing changes; each round is checkpointed.
    """
    from ..graph import connected

    key = lambda c: F.concat_ws(":", "request_id", c)
    edges = pairs.select(key("a").alias("a"), key("b").alias("b"))
    labels = connected(edges)
    rows = segs.select("request_id", "seg_idx", key("seg_idx").alias("node"))
    joined = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("seg_idx").alias("cluster"))
    return joined.join(least, "root").select("request_id", "seg_idx", "cluster")


def representatives(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each group the member that stays: those in the cached prefix first, then the earliest."""
    return rows.groupBy(*group).agg(F.min(F.struct((~F.col("in_prefix")).alias("late"), "seg_idx")).alias("m"), F.count("*").alias("members")).select(*group, F.col("m.seg_idx").alias("representative"), "members")


def drop_exact(segs: DataFrame) -> DataFrame:
    """``segs`` without later segments whose type and rewrite hash an earlier one of the request has."""
    order = Window.partitionBy("request_id", "segment_type", "rewrite_hash").orderBy("seg_idx")
    kept = eligible(segs).withColumn("rewrite_hash", T.rewrite_hash(F.col("text"))).withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("rewrite_hash", "copy")
    return kept.unionByName(segs.where(F.col("segment_type").isin(EXCLUDED)))


def stub(segment_hash: Column) -> Column:
    return F.concat(F.lit("[dup of seg_"), F.left(segment_hash, F.lit(8)), F.lit("]"))
