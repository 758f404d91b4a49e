"""Requests as typed, hashed segments, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def segments(conversations: DataFrame) -> DataFrame:
    """One row a turn: request_id, seg_idx, role, segment_type, text, segment_hash, token_count. No shuffle: the turn is the index."""
    text = F.coalesce("text", F.lit(""))
    return conversations.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), "role", T.segment_type(text, F.col("role")).alias("segment_type"),
        text.alias("text"), T.segment_hash(text).alias("segment_hash"), T.token_estimate(text).alias("token_count"),
    )


def content_segments(requests: DataFrame) -> DataFrame:
    """Segments of nested requests (request_id, system array<block>, messages array<struct<role, content array<block>>>, tools array<struct<name, description,
    parameters>>): system blocks, then messages by block, then tools; images and tool calls become stub texts."""
    block = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"].isin("image_url", "image_base64"), F.lit("[image]")).when(b["type"] == "tool_use", F.concat_ws(" ", F.lit("tool_use:"), b["tool_name"], b["tool_input"])).otherwise(F.coalesce(b["text"], F.lit("")))
    system = requests.select("request_id", F.posexplode("system").alias("i", "b")).where("b.type = 'text'").select("request_id", F.lit(0).alias("part"), F.lit(0).alias("m"), "i", F.lit("system").alias("role"), F.lit("text").alias("kind"), F.col("b.text").alias("text"))
    messages = requests.select("request_id", F.posexplode("messages").alias("m", "x")).select("request_id", "m", F.col("x.role").alias("role"), F.posexplode("x.content").alias("i", "b"))
    messages = messages.select("request_id", F.lit(1).alias("part"), "m", "i", "role", F.col("b.type").alias("kind"), block(F.col("b")).alias("text"))
    tools = requests.select("request_id", F.posexplode("tools").alias("i", "t")).select("request_id", F.lit(2).alias("part"), F.lit(0).alias("m"), "i", F.lit("tool_schema").alias("role"), F.lit("tool_schema").alias("kind"), F.to_json("t").alias("text"))
    every = system.unionByName(messages).unionByName(tools)
    kind = F.when(F.col("kind") == "tool_use", "TOOL_SCHEMA").when(F.col("kind") == "tool_schema", "TOOL_SCHEMA").when(F.col("kind") == "tool_result", "TOOL_RESULT").when(F.col("kind").startswith("image"), "UNKNOWN").otherwise(T.segment_type(F.coalesce("text", F.lit("")), F.col("role")))
    return every.select("request_id", "part", "m", "i", "role", kind.alias("segment_type"), F.coalesce("text", F.lit("")).alias("text"))


def joined_texts(segs: DataFrame, separator: str = "\n", name: str = "full_text") -> DataFrame:
    """The texts of a request in order."""
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return segs.groupBy("request_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias(name))


def template_signature(segs: DataFrame) -> DataFrame:
    """SHA-256 of the type sequence and the hashes of the system segments."""
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", "segment_type", "segment_hash")))
    kinds = F.array_join(F.transform("rows", lambda r: r["segment_type"]), ",")
    systems = F.array_join(F.transform(F.filter("rows", lambda r: r["segment_type"] == "SYSTEM_INSTRUCTION"), lambda r: r["segment_hash"]), "|")
    return segs.groupBy("request_id").agg(rows.alias("rows")).select("request_id", F.sha2(F.concat(kinds, F.lit("|"), systems), 256).alias("template_signature"))


def final_user_query(conversations: DataFrame) -> DataFrame:
    return conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("request_id")).agg(F.max_by("text", "turn").alias("query"))


def reassemble(segs: DataFrame, original: DataFrame) -> DataFrame:
    """Messages of rewritten segments; where these are no shorter than the original ones, the original is used."""
    packed = lambda df, name: df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "role", "text"))).alias(name))
    both = packed(original, "raw").join(packed(segs, "new"), "request_id", "left")
    shorter = F.length(F.to_json("new")) < F.length(F.to_json("raw"))
    return both.select("request_id", F.coalesce(shorter, F.lit(False)).cast("int").alias("rewritten"), F.when(shorter, F.col("new")).otherwise(F.col("raw")).alias("messages"))
