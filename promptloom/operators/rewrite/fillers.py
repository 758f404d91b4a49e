"""S2: filler phrases in system segments, and verified stored rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import text as T

# Fixed values, in order: pattern and what takes its place.
FILLERS = [
    ("Please make sure (that )?you (always )?", ""), ("Please ensure (that )?", ""), ("It is important (that )?you (always )?", ""), ("Please note that", "Note:"), ("Feel free to", ""), ("As an AI (assistant|language model|chatbot),?\\s*", ""),
    ("I('d| would) like you to", ""), ("Your task is to", ""), ("In order to", ""), ("You should always", "Always"), ("You must always", "Always"), ("Make sure (that )?to", ""), ("Be sure (that )?to", ""), ("Please (be aware|note)\\s+(that\\s+)?", ""),
    ("It('s| is) worth noting that", ""), ("I want you to", ""), ("You are (going to|here to|tasked to|supposed to)", ""), ("You will need to", ""), ("I('m| am) going to (need|ask) you to", ""),
]
MIN_REUSE = 10


def strip_fillers(text: Column) -> Column:
    """Each rule in turn, unless it would lose a normative token. The rules run as one fold, so the plan holds the text once."""
    rules = F.array(*(F.struct(F.lit(f"(?iU){p}").alias("p"), F.lit(r).alias("r")) for p, r in FILLERS))

    def step(now: Column, rule: Column) -> Column:
        new = F.regexp_replace(now, rule["p"], rule["r"])
        return F.when(F.size(F.array_except(T.normative_tokens(now), T.normative_tokens(new))) == 0, new).otherwise(now)

    return F.aggregate(rules, text, step)


def rewrite_ok(original: Column, rewritten: Column, values: Column) -> Column:
    """No normative token and no manifest value (in any case) is lost."""
    kept = F.size(F.array_except(T.normative_tokens(original), T.normative_tokens(rewritten))) == 0
    return kept & F.forall(values, lambda v: F.contains(F.lower(rewritten), F.lower(v)))


def job_status(templates: DataFrame, min_reuse: int = MIN_REUSE) -> DataFrame:
    """What the offline rewrite does with each template: columns reuse_count, breakeven, rewritten, verified."""
    status = F.when(F.col("reuse_count").isNull(), "not_found").when(F.col("reuse_count") < min_reuse, "skipped_low_reuse").when(~F.col("breakeven"), "breakeven_failed").when(F.col("rewritten").isNull(), "rewriter_error").when(~F.col("verified"), "verify_failed").otherwise("ok")
    return templates.withColumn("status", status)
