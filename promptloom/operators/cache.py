"""Three cache tiers as joins: exact keys, vectors within a namespace, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.dimensions import DEFAULT_LIFE_TIME
from .gate import set_jaccard

HOT_TEMPERATURE, CROSS_FLOOR, CONTEXT_CHARS, SAVINGS_WEIGHT = 0.3, 0.85, 1024, 1e-4
# Finish reasons of whole answers.
TERMINAL = ["stop", "end_turn", "tool_use"]


def exact_key(provider: Column, model: Column, params: Column, messages: Column) -> Column:
    """SHA-256 of a canonical JSON; null if the temperature forbids caching. ``params`` is a map of strings; 'stream' does not count and the temperature
    is rounded to one place."""
    heat = F.try_element_at(params, F.lit("temperature")).cast("double")
    kept = F.map_filter(params, lambda k, v: ~k.isin("stream", "temperature"))
    entries = F.array_sort(F.map_entries(kept))
    key = F.to_json(F.struct(provider.alias("provider"), model.alias("model"), entries.alias("params"), F.round(heat, 1).alias("temperature"), messages.alias("messages")))
    return F.when(F.coalesce(heat, F.lit(0.0)) <= HOT_TEMPERATURE, F.sha2(key, 256))


def cacheable(finish_reason: Column, error: Column) -> Column:
    return (finish_reason.isNull() | finish_reason.isin(TERMINAL)) & error.isNull()


def replay(log: DataFrame) -> DataFrame:
    """log (request_id, tenant_id, key, at, ttl) with hit: an equal key of the tenant was stored within its life time.

    A miss stores the answer; a hit does not, so a run of equal keys is cut where it outlives its first entry. Whether entry n is fresh
    depends on which ones were stored, so the rows of one key are folded in order.
    """
    from .sequential import fold

    class Entry:
        until = None

    def step(entry: Entry, row: dict) -> tuple:
        if entry.until is not None and row["at"] < entry.until:
            return row["request_id"], 1
        entry.until = row["at"] + row["ttl"]
        return row["request_id"], 0

    return fold(log.select("request_id", "tenant_id", "key", "at", "ttl"), ["tenant_id", "key"], ["at", "request_id"], Entry, step, "request_id long, hit int")


def seen_within(log: DataFrame, seconds: Column) -> DataFrame:
    """log (request_id, tenant_id, key, at) with hit: the row before it of the same key is at most ``seconds`` old (entries renewed on use)."""
    order = Window.partitionBy("tenant_id", "key").orderBy("at", "request_id")
    return log.withColumn("hit", F.coalesce(F.col("at") - F.lag("at").over(order) < seconds, F.lit(False)).cast("int"))


def life_time(log: DataFrame, dimension: DataFrame) -> DataFrame:
    return log.join(F.broadcast(dimension), "request_class", "left").withColumn("ttl_seconds", F.coalesce("ttl_seconds", F.lit(DEFAULT_LIFE_TIME)))


def namespace(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(f, F.lit("")) for f in fields)), 256)


def query_text(prior: Column, query: Column) -> Column:
    """The last CONTEXT_CHARS characters of the prior context, then the query."""
    return F.concat(F.right(prior, F.lit(CONTEXT_CHARS)), F.lit("\n"), query)


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != ""))
    return set_jaccard(words(a), words(b))


def accept(cosine: Column, tau: Column, cross: Column, cached_numbers: Column, new_numbers: Column) -> Column:
    """Near enough, reranked high enough, and no new number that the cached answer did not have."""
    return (cosine >= tau) & (cross >= CROSS_FLOOR) & (F.size(F.array_except(new_numbers, cached_numbers)) == 0)


def evict(entries: DataFrame, capacity: int) -> DataFrame:
    """The entries that stay: those with the greatest next-to-last access plus a little for tokens saved; ``capacity`` is for each namespace, as a
    rank over everything would go through one task."""
    order = Window.partitionBy("namespace").orderBy((F.col("last_access_1") + F.col("tokens_saved") * SAVINGS_WEIGHT).desc(), "entry_id")
    return entries.withColumn("n", F.row_number().over(order)).where(F.col("n") <= capacity).drop("n")


def invalidate(plans: DataFrame, changed: DataFrame) -> DataFrame:
    """Plans (key, depends_on array) that depend on none of the changed (doc) hashes."""
    touched = plans.select("key", F.explode("depends_on").alias("doc")).join(changed.distinct(), "doc", "left_semi").select("key").distinct()
    return plans.join(touched, "key", "left_anti")
