"""S5: old turns distilled to a ledger of decisions, facts and open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions import arrow as P, text as T
from ..signals import near_after

#: Turn and sentence share one number; a whole turn stands behind all of its sentences.
TURN, LATER = 1_000_000_000, 400_000_000
MIN_DEPTH, MIN_TOKENS, KEEP, GENTLE, SIMILAR, RESURRECT = 8, 4000, 6, 1.5, 0.60, 0.45
# Fixed patterns of decisions, commitments and facts.
DECISION = r"(?iU)\b(?:must|never|always|only|exactly|shall|do not|required|forbidden|shall not|should not|need to|have to)\b"
COMMITMENT = r"(?iU)\b(?:i want|use |in [a-z]+|format|write in|reply in|respond in)\b"
FACT = r"(?U)\$[0-9,]+(?:\.[0-9]+)?[MBKkm]?|\b[0-9]+(?:[,0-9]*\.?[0-9]+)?(?:%|percent)?\b|\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b"


def turn_groups(segs: DataFrame) -> DataFrame:
    """``segs`` with turn_group: a group ends with an assistant turn; a user turn after a user turn begins one."""
    order = Window.partitionBy("request_id").orderBy("seg_idx")
    starts = (F.col("role") == "user") | (F.coalesce(F.lag("role").over(order), F.lit("assistant")) == "assistant")
    return segs.where("role IN ('user', 'assistant')").withColumn("starts", starts.cast("int")).withColumn("turn_group", F.sum("starts").over(order)).drop("starts")


def aging(grouped: DataFrame, keep: int = KEEP) -> DataFrame:
    """Turns of all but the last ``keep`` groups."""
    last = grouped.groupBy("request_id").agg(F.max("turn_group").alias("last"))
    return grouped.join(last, "request_id").where(F.col("turn_group") <= F.col("last") - keep).drop("last")


def lexical_diversity(text: Column) -> Column:
    found = T.words(F.lower(text))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(found)) / F.size(found))


def exemplars(grouped: DataFrame, factor: float = GENTLE) -> DataFrame:
    """(request_id, seg_idx) of the groups whose assistant turn's lexical diversity is over ``factor`` times its conversation's mean."""
    turns = grouped.where("role = 'assistant'").withColumn("ttr", lexical_diversity(F.col("text")))
    mean = turns.groupBy("request_id").agg(F.avg("ttr").alias("mean_ttr"))
    rich = turns.join(mean, "request_id").where(F.col("ttr") > factor * F.col("mean_ttr")).select("request_id", "turn_group")
    return grouped.join(rich, ["request_id", "turn_group"], "left_semi").select("request_id", "seg_idx")


def bucket(sentence: Column) -> Column:
    """decision, fact, open, or null."""
    return F.when(sentence.rlike(DECISION) | sentence.rlike(COMMITMENT), "decision").when(sentence.rlike(FACT), "fact").when(T.strip(sentence).endswith("?"), "open")


def is_greeting(sentence: Column) -> Column:
    low = F.lower(sentence)
    out = F.lit(False)
    for g in T.GREETINGS:
        out = out | F.contains(low, F.lit(g))
    return out


def split(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), T.strip), lambda s: s != "")


def entries(grouped: DataFrame, keep: int = KEEP, similar: float = SIMILAR) -> DataFrame:
    """(request_id, seg_idx, place, sentence, bucket) of the old turns: no greetings, none like a kept sentence or a later assistant
    turn, the first of equal ones."""
    old = aging(grouped, keep)
    retained = grouped.join(old.select("request_id", "seg_idx"), ["request_id", "seg_idx"], "left_anti")
    said = old.select("request_id", "seg_idx", F.posexplode(split(F.col("text"))).alias("place", "sentence")).withColumn("bucket", bucket(F.col("sentence"))).where(F.col("bucket").isNotNull() & ~is_greeting(F.col("sentence")))
    said = said.withColumn("n", F.row_number().over(Window.partitionBy("request_id", "bucket", "sentence").orderBy("seg_idx", "place"))).where("n = 1").drop("n")
    left = said.select("request_id", (F.col("seg_idx") * TURN + F.col("place")).alias("seg_idx"), F.col("sentence").alias("text"))
    kept = retained.select("request_id", F.lit(LATER).alias("seg_idx"), F.explode(split(F.col("text"))).alias("text"))
    later = grouped.where("role = 'assistant'").select("request_id", "seg_idx", "text")
    turn = F.floor(F.col("seg_idx") / TURN)
    near = near_after(left, kept.unionByName(later), similar).where(F.col("last") > turn)
    gone = near.select("request_id", turn.alias("seg_idx"), (F.col("seg_idx") % TURN).alias("place")).distinct()
    return said.join(gone, ["request_id", "seg_idx", "place"], "left_anti")


def formatted(rows: DataFrame) -> DataFrame:
    """(request_id, ledger): the entries of each bucket in order."""
    def part(name: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("bucket") == name, F.struct("seg_idx", "place", "sentence"))))
        return F.coalesce(F.nullif(F.array_join(F.transform(own, lambda r: r["sentence"]), "; "), F.lit("")), F.lit("none"))

    return rows.groupBy("request_id").agg(F.concat(F.lit("«Conversation ledger: decisions=["), part("decision"), F.lit("], facts=["), part("fact"), F.lit("], open=["), part("open"), F.lit("]»")).alias("ledger"))


def replace_old(segs: DataFrame, old: DataFrame, ledgers: DataFrame) -> DataFrame:
    """``segs`` without the old turns; the ledger stands where the first of them was."""
    first = old.groupBy("request_id").agg(F.min("seg_idx").alias("seg_idx"))
    block = first.join(ledgers, "request_id").select("request_id", "seg_idx", F.lit("assistant").alias("role"), F.lit("ASSISTANT_TURN").alias("segment_type"), F.col("ledger").alias("text"), T.segment_hash(F.col("ledger")).alias("segment_hash"), T.token_estimate(F.col("ledger")).alias("token_count"))
    return segs.join(old.select("request_id", "seg_idx"), ["request_id", "seg_idx"], "left_anti").unionByName(block)


def first_changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(request_id, first_changed): the first turn whose hash differs on the two sides, else the number of turns before."""
    both = before.select("request_id", "seg_idx", F.col("segment_hash").alias("h1")).join(now.select("request_id", "seg_idx", F.col("segment_hash").alias("h2")), ["request_id", "seg_idx"], "left")
    differs = F.min(F.when(F.col("h1") != F.col("h2"), F.col("seg_idx")))
    return both.groupBy("request_id").agg(F.coalesce(differs, F.count("*")).alias("first_changed"))


def resurrect(old: DataFrame, ledgers: DataFrame, queries: DataFrame, margin: float = RESURRECT) -> DataFrame:
    """(request_id, seg_idx, gain): the old turn that the query is closest to, if it is closer by ``margin`` than to the ledger."""
    rows = old.join(ledgers, "request_id").join(queries, "request_id")
    gain = P.text_cosine("query", "text") - P.text_cosine("query", "ledger")
    scored = rows.select("request_id", "seg_idx", gain.alias("gain")).where(F.col("gain") > margin)
    return scored.groupBy("request_id").agg(F.max(F.struct("gain", (-F.col("seg_idx")).alias("neg"))).alias("m")).select("request_id", (-F.col("m.neg")).alias("seg_idx"), F.col("m.gain").alias("gain"))
