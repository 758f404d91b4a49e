"""What the passes share: byte offsets and the rule that protects cached prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def byte_offsets(segs: DataFrame) -> DataFrame:
    """``segs`` with start_byte: bytes of the request before the segment."""
    before = Window.partitionBy("request_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))


def prefix_safe(start_byte: Column, prefix_bytes: Column, tokens_saved: Column, price_per_token: Column, cache_value: Column) -> Column:
    """A change inside the cached prefix must be worth more than the prefix's cache."""
    return (start_byte >= prefix_bytes) | (tokens_saved * price_per_token > cache_value)
