"""Signals of requests: depth, mass, ratios, redundancy and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import arrow as P, text as T
from .graph import saved

#: Tool results this many messages before the last are stale.
STALE_AFTER = 6
REDUNDANT = 0.70
# Verbs of four request classes.
VERBS = {
    "EXTRACTION": ["extract", "parse", "find", "list", "identify", "enumerate", "locate", "retrieve", "fetch", "pull", "get", "read", "scan", "search", "look for", "what is", "what are", "how many", "which"],
    "GENERATION_CREATIVE": ["write", "compose", "draft", "create", "craft", "imagine", "invent", "generate", "design", "build", "produce", "make", "tell", "narrate", "describe", "illustrate"],
    "REASONING": ["solve", "calculate", "compute", "prove", "analyze", "analyse", "derive", "deduce", "explain", "reason", "determine", "evaluate", "assess", "compare", "contrast", "why", "how does"],
    "SUMMARIZATION": ["summarize", "summarise", "condense", "outline", "digest", "recap", "overview", "brief", "tldr", "tl;dr", "shorten", "compress", "abstract", "distil", "distill"],
}


def history_depth(conversations: DataFrame) -> DataFrame:
    """Pairs of a user message and the assistant message right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.where("role <> 'system'").select("conv_id", "role", F.lead("role").over(order).alias("next"))
    return rows.groupBy(F.col("conv_id").alias("request_id")).agg(F.count_if((F.col("role") == "user") & (F.col("next") == "assistant")).alias("history_depth"))


def stale_mass(segs: DataFrame, result_type: str = "TOOL_RESULT", after: int = STALE_AFTER) -> DataFrame:
    """Tokens of results that lie more than ``after`` messages before the request's last."""
    last = segs.groupBy("request_id").agg(F.max("seg_idx").alias("last"))
    old = (F.col("segment_type") == result_type) & (F.col("seg_idx") < F.col("last") - after)
    return segs.join(last, "request_id").groupBy("request_id").agg(F.sum(F.when(old, F.col("token_count")).otherwise(0)).alias("stale_mass"))


def verb_counts(text) -> list:
    """One number a class: single words by token, phrases by occurrence."""
    low = F.lower(text)
    found = T.words(low)
    out = []
    for name, lexicon in VERBS.items():
        single = [v for v in lexicon if " " not in v]
        number = F.size(F.filter(found, (lambda items: lambda w: w.isin(items))(single)))
        for phrase in (v for v in lexicon if " " in v):
            number = number + F.regexp_count(low, F.lit(phrase))
        out.append(number.cast("long").alias(f"n_{name.lower()}"))
    return out


def band_rows(signatures: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """(keys, id, band, value): ``rows`` places of a signature a band."""
    bands = P.PERMUTATIONS // rows
    pieces = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("sig", b * rows + 1, rows)).alias("value")))
    return signatures.select(*keys, "id", F.explode(pieces).alias("p")).select(*keys, "id", "p.band", "p.value")


def near_texts(distinct: DataFrame, threshold: float, keys: tuple[str, ...] = ("request_id", "segment_type"), others: DataFrame | None = None) -> DataFrame:
    """(keys, a, b, jaccard): ids of different texts of a group whose estimate is at least ``threshold``; no pair is missed. Without
    ``others`` a < b; with them a is of ``distinct`` and b of ``others``, and no pair within a side is made.

    An estimate of t leaves (1 - t) * 128 unequal places, which can't touch all bands if there are more bands than that, so equal bands
    find every pair without comparing all. Signatures are made once.
    """
    unequal = int((1 - threshold) * P.PERMUTATIONS + 1e-9)
    rows = max(r for r in range(1, 9) if P.PERMUTATIONS // r > unequal)
    sign = lambda df: saved(df.select(*keys, "id", P.minhash("text").alias("sig")))
    left = sign(distinct)
    right = left if others is None else sign(others)
    bands = lambda df, n: band_rows(df, rows, list(keys)).withColumnRenamed("id", n)
    pairs = bands(left, "a").join(bands(right, "b"), [*keys, "band", "value"]).where("a < b" if others is None else "a <> b").select(*keys, "a", "b").distinct()
    sides = lambda df, n: df.select(*keys, F.col("id").alias(n), F.col("sig").alias(f"sig_{n}"))
    scored = pairs.join(sides(left, "a"), [*keys, "a"]).join(sides(right, "b"), [*keys, "b"])
    return scored.select(*keys, "a", "b", P.jaccard_estimate(F.col("sig_a"), F.col("sig_b")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def near_pairs(segs: DataFrame, threshold: float, keys: tuple[str, ...] = ("request_id", "segment_type")) -> DataFrame:
    """(keys, a, b, jaccard): near pairs of different texts, each text under its smallest seg_idx, and its copies paired with that one.

    For pairs by side or order use ``near_after``, which sees every place of a text.
    """
    distinct = segs.groupBy(*keys, "text").agg(F.min("seg_idx").alias("id"))
    near = near_texts(distinct, threshold, keys)
    firsts = distinct.select(*keys, "text", F.col("id").alias("a"))
    copies = segs.select(*keys, "text", F.col("seg_idx").alias("b")).join(firsts, [*keys, "text"]).where("a < b").select(*keys, "a", "b", F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies)


def near_after(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(request_id, seg_idx, last): segments of ``left`` with the largest seg_idx of each text of ``right`` in the request that is equal or near."""
    named = lambda df: df.select("request_id", "text").where("text IS NOT NULL").distinct().withColumn("id", F.xxhash64("text"))
    asked, there = named(left), named(right)
    near = near_texts(asked, threshold, ("request_id",), there)
    same = asked.join(there, ["request_id", "id"], "left_semi").select("request_id", F.col("id").alias("a"), F.col("id").alias("b"))
    ends = near.select("request_id", "a", "b").unionByName(same)
    last = right.groupBy("request_id", F.xxhash64("text").alias("b")).agg(F.max("seg_idx").alias("last"))
    return left.select("request_id", "seg_idx", F.xxhash64("text").alias("a")).join(ends, ["request_id", "a"]).join(last, ["request_id", "b"]).select("request_id", "seg_idx", "last")


def redundancy(segs: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    """Share of segments with a sibling of their type at least this similar; 0 for fewer than two segments."""
    pairs = near_pairs(segs, threshold)
    hit = pairs.select("request_id", F.explode(F.array("a", "b")).alias("seg_idx")).distinct().groupBy("request_id").agg(F.count("*").alias("hit"))
    total = segs.groupBy("request_id").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.coalesce("hit", F.lit(0)) / F.col("n"))
    return total.join(hit, "request_id", "left").select("request_id", share.alias("redundancy_score"))


def prefix_span(prefixes: DataFrame) -> DataFrame:
    """Common leading bytes with the request before it of the same tenant and template: (request_id, tenant_id, template, ts, prefix)."""
    order = Window.partitionBy("tenant_id", "template").orderBy("ts", "request_id")
    return prefixes.withColumn("before", F.lag("prefix").over(order)).select("request_id", P.common_prefix_bytes("prefix", F.coalesce("before", F.lit(""))).alias("prefix_span"))
