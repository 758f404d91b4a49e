"""S6: white space, JSON, tables, stale tool results and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions import arrow as P, text as T
from ..signals import near_after

KEEP_AFTER, SUPERSEDED = 3, 0.50


def canonical(text: Column, segment_type: Column) -> Column:
    return F.when(segment_type.isin("CODE_BLOCK", "STRUCTURED_DATA"), text).otherwise(T.tidy(text))


def minified(text: Column, segment_type: Column) -> Column:
    return F.when(segment_type.isin("STRUCTURED_DATA", "TOOL_RESULT"), P.json_minify(text)).otherwise(text)


def assistant_turns_after(segs: DataFrame) -> DataFrame:
    after = Window.partitionBy("request_id").orderBy("seg_idx").rowsBetween(1, Window.unboundedFollowing)
    return segs.withColumn("turns_after", F.coalesce(F.sum((F.col("segment_type") == "ASSISTANT_TURN").cast("int")).over(after), F.lit(0)))


def expired(segs: DataFrame, result_type: str = "TOOL_RESULT", keep_after: int = KEEP_AFTER, similar: float = SUPERSEDED) -> DataFrame:
    """(request_id, seg_idx) of results with more assistant turns behind them than ``keep_after``, one of them like the result; never the last."""
    last = segs.where(F.col("segment_type") == result_type).groupBy("request_id").agg(F.max("seg_idx").alias("last"))
    old = assistant_turns_after(segs).where((F.col("segment_type") == result_type) & (F.col("turns_after") > keep_after)).join(last, "request_id").where("seg_idx < last")
    said = segs.where("segment_type = 'ASSISTANT_TURN'")
    return near_after(old, said, similar).where("last > seg_idx").select("request_id", "seg_idx").distinct()


def expiry_stub(tool_name: Column) -> Column:
    return F.concat(F.lit("[tool_result:"), F.coalesce(tool_name, F.lit("tool")), F.lit(":expired]"))


def pruned_schema(text: Column) -> Column:
    """The first sentence, if there is more behind it."""
    first = T.first_sentence(text)
    return F.when(first == "", text).otherwise(first)
