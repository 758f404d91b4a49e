"""Quality score, ordered rollback, parity and fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrow as P, text as T

WEIGHTS = {"coverage": 0.45, "semantic": 0.30, "window": 0.15, "margin": 0.10}
FLOOR, LOSSY_FLOOR = 0.98, 0.99
#: The order in which passes run, and in which they are undone.
RUN_ORDER = ["S2", "S1", "S6", "S3", "S5", "S4", "S7"]
ROLLBACK_ORDER = ["S7", "S4", "S3", "S5", "S1"]


def quality(coverage: Column, polarity_ok: Column, semantic: Column, window: Column, margin: Column) -> Column:
    """0 if a constraint is lost or a polarity broken, else the weighted sum."""
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (margin - 0.9) / 0.1))
    total = WEIGHTS["coverage"] * coverage + WEIGHTS["semantic"] * semantic + WEIGHTS["window"] * window + WEIGHTS["margin"] * scaled
    return F.when((coverage < 1) | ~polarity_ok, F.lit(0.0)).otherwise(total)


def floor(lossy: Column) -> Column:
    return F.when(lossy, F.lit(LOSSY_FLOOR)).otherwise(F.lit(FLOOR))


def rollback(attempts: DataFrame) -> DataFrame:
    """(request_id, stage): the first attempt that passes, in rollback order, 'none' if the full result does, 'raw' if nothing does.

    ``attempts``: (request_id, stage, qps, floor), stage 'none' or the last pass undone.
    """
    place = F.array_position(F.array(*map(F.lit, ["none", *ROLLBACK_ORDER])), F.col("stage"))
    best = F.min(F.when(F.col("qps") >= F.col("floor"), F.struct(place.alias("p"), F.col("stage").alias("s"))))
    return attempts.groupBy("request_id").agg(F.coalesce(best["s"], F.lit("raw")).alias("stage"))


def snapshot_after(versions: DataFrame, undone: DataFrame) -> DataFrame:
    """Segments of ``versions`` (request_id, stage_idx, seg_idx, text) as they were before the earliest pass undone (request_id, undo_idx)."""
    rows = versions.join(undone, "request_id").where(F.col("stage_idx") < F.col("undo_idx"))
    last = rows.groupBy("request_id").agg(F.max("stage_idx").alias("stage_idx"))
    return rows.join(last, ["request_id", "stage_idx"]).select("request_id", "seg_idx", "text")


def window_fidelity(pairs: DataFrame) -> DataFrame:
    """(id, fidelity): least cosine of aligned two-sentence windows of (id, original, rewritten); the last window is used again where one side has
    more; 1 for two texts without sentences."""
    def windows(name: str) -> DataFrame:
        cut = T.coverage_sentences(F.col(name))
        rows = pairs.select("id", F.posexplode(cut).alias("i", "s"))
        order = Window.partitionBy("id").orderBy("i")
        size = rows.groupBy("id").agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
        return rows.withColumn("next", F.lead("s").over(order)).select("id", "i", F.concat_ws(" ", "s", "next").alias("w")).join(size, "id").where("i < n")

    left, right = windows("original"), windows("rewritten")
    sizes = left.groupBy("id").agg(F.max("n").alias("a")).join(right.groupBy("id").agg(F.max("n").alias("b")), "id", "full_outer")
    places = sizes.where("a IS NOT NULL AND b IS NOT NULL").select("id", F.explode(F.sequence(F.lit(0), F.greatest("a", "b").cast("int") - 1)).alias("k"), "a", "b")
    aligned = places.select("id", F.least("k", F.col("a") - 1).cast("int").alias("i"), F.least("k", F.col("b") - 1).cast("int").alias("j"))
    both = aligned.join(left.select("id", "i", F.col("w").alias("x")), ["id", "i"]).join(right.select("id", F.col("i").alias("j"), F.col("w").alias("y")), ["id", "j"])
    scored = both.groupBy("id").agg(F.min(P.text_cosine("x", "y")).alias("f"))
    return pairs.select("id").join(scored, "id", "left").join(sizes, "id", "left").select("id", F.when(F.col("a").isNull() & F.col("b").isNull(), F.lit(1.0)).otherwise(F.coalesce("f", F.lit(0.0))).alias("fidelity"))


def set_jaccard(x: Column, y: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def task_checks(new: Column, old: Column) -> Column:
    """Mean of: both JSON or neither, length within a factor of two, both refuse or neither."""
    json = T.looks_json(new) == T.looks_json(old)
    ratio = F.length(new) / F.greatest(F.length(old), F.lit(1))
    refuse = T.has_word(new, T.REFUSALS) == T.has_word(old, T.REFUSALS)
    return (json.cast("int") + ratio.between(0.5, 2.0).cast("int") + refuse.cast("int")) / 3


def parity(new: Column, old: Column, new_entities: Column, old_entities: Column) -> Column:
    return 0.5 * P.text_cosine(new, old) + 0.3 * set_jaccard(new_entities, old_entities) + 0.2 * task_checks(new, old)
