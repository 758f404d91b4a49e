"""All seven passes in their order, each behind its gates, with a version of every request's segments after each, and the gate that undoes passes.

A pass touches a request only where its route allows it, where the pass's own conditions hold (budget, depth, density, intent), and no byte of
a cached prefix unless that pays. A segment that a pass can't rewrite (null) stays as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import arrow as P, text as T
from . import gate, manifest
from .graph import saved
from .rewrite import common, dedupe, documents, fillers, hygiene, ledger, lossy, window
from .segments import joined_texts

COLUMNS = ["request_id", "seg_idx", "role", "segment_type", "text"]
#: Version that is left when the named pass and those before it in the rollback order are undone: the one before the earliest of them.
SNAPSHOTS = {"none": len(gate.RUN_ORDER)} | {p: min(map(gate.RUN_ORDER.index, gate.ROLLBACK_ORDER[: k + 1])) for k, p in enumerate(gate.ROLLBACK_ORDER)}


def with_hashes(segs: DataFrame) -> DataFrame:
    return segs.select(*COLUMNS).withColumn("segment_hash", T.segment_hash(F.col("text"))).withColumn("token_count", T.token_estimate(F.col("text")))


def prefix_guard(before: DataFrame, after: DataFrame, prefixes: DataFrame | None) -> DataFrame:
    """``after``, but segments that begin in a cached prefix are as ``before`` where the change does not pay.

    ``prefixes``: (request_id, prefix_bytes, price, cache_value); requests without a row have nothing cached."""
    if prefixes is None:
        return after
    old = common.byte_offsets(before).select("request_id", "seg_idx", "start_byte", *(F.col(c).alias(f"old_{c}") for c in COLUMNS[2:]), F.col("token_count").alias("old_tokens"))
    both = old.join(after.select(*COLUMNS, "token_count", F.lit(True).alias("is_there")), ["request_id", "seg_idx"], "full_outer").join(prefixes, "request_id", "left")
    won = F.col("old_tokens") - F.coalesce("token_count", F.lit(0))
    safe = common.prefix_safe(F.col("start_byte"), F.coalesce("prefix_bytes", F.lit(0)), won, F.col("price"), F.col("cache_value"))
    changed = ~F.col("old_text").eqNullSafe(F.col("text"))
    undo = F.col("old_text").isNotNull() & changed & ~F.coalesce(safe, F.lit(True))
    rows = both.where(F.coalesce("is_there", F.lit(False)) | undo)
    return with_hashes(rows.select("request_id", "seg_idx", *(F.when(undo, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS[2:])))


def pass_s1(segs: DataFrame, items: DataFrame) -> DataFrame:
    """Exact copies go; near ones become a stub of the segment that stays, unless a constraint's value is in the copy alone."""
    kept = dedupe.drop_exact(segs)
    pairs = dedupe.similar_pairs(kept)
    later = pairs.groupBy("request_id", F.col("b").alias("seg_idx")).agg(F.min("a").alias("of"))
    first = kept.select("request_id", F.col("seg_idx").alias("of"), dedupe.stub(F.col("segment_hash")).alias("stub"), F.col("text").alias("of_text"))
    marked = later.join(first, ["request_id", "of"]).join(kept.select("request_id", "seg_idx", F.col("text").alias("own_text")), ["request_id", "seg_idx"])
    lost = F.contains("own_text", F.col("value")) & ~F.contains("of_text", F.col("value"))
    losers = marked.join(items.select("request_id", "value").distinct(), "request_id").where(lost).select("request_id", "seg_idx").distinct()
    stubs = marked.join(losers, ["request_id", "seg_idx"], "left_anti").select("request_id", "seg_idx", "stub")
    return with_hashes(kept.join(stubs, ["request_id", "seg_idx"], "left").withColumn("text", F.coalesce("stub", "text")))


def pass_s6(segs: DataFrame) -> DataFrame:
    """White space, JSON, tables, results that later turns have replaced, and schemas cut to their first sentence."""
    kind = F.col("segment_type")
    clean = hygiene.minified(hygiene.canonical(F.col("text"), kind), kind)
    clean = F.when(kind.isin("CODE_BLOCK", "STRUCTURED_DATA"), clean).otherwise(T.depad_tables(clean))
    clean = F.when(kind == "TOOL_SCHEMA", hygiene.pruned_schema(clean)).otherwise(clean)
    stale = hygiene.expired(segs).withColumn("stub", hygiene.expiry_stub(F.lit(None).cast("string")))
    return with_hashes(segs.join(stale, ["request_id", "seg_idx"], "left").withColumn("text", F.coalesce("stub", clean, "text")))


def long_documents(segs: DataFrame, queries: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Scored chunks of the documents over the budget of requests well over it, keyed by request and segment, and the keys."""
    key = F.concat_ws(":", "request_id", "seg_idx")
    is_doc = F.col("segment_type").isin("RETRIEVED_DOC", "STRUCTURED_DATA")
    total = segs.groupBy("request_id").agg(F.sum("token_count").alias("n"), F.bool_or(is_doc).alias("has"))
    asks = total.where(window.applies(F.col("n"), F.lit(budget), F.col("has"), F.lit("ALLOWED"))).select("request_id")
    docs = segs.where(is_doc & (F.col("token_count") > budget)).join(asks, "request_id", "left_semi").withColumn("id", key)
    asked = docs.select("id", "request_id").join(queries, "request_id").select("id", "query")
    return docs, window.chunk_scores(window.chunks(docs, "id"), asked)


def pass_s3(segs: DataFrame, queries: DataFrame, items: DataFrame, budget: int, floor: float) -> DataFrame:
    """Long documents cut to the chunks with most of the score, every entity and query term, and the sentences that govern a kept value."""
    docs, scored = long_documents(segs, queries, budget)
    held = docs.select("request_id", "id", "text").join(items, "request_id").where(F.contains("text", F.col("value")))
    covered = held.where("item_type IN ('entity', 'query_term')").select("id", "value").distinct()
    spans = held.where("governing_span <> ''").select("id", F.col("governing_span").alias("span")).distinct()
    kept = window.force_neighbours(window.top_mass(scored, floor, covered), spans)
    cut = window.reassemble(kept).select("id", F.col("text").alias("cut"))
    found = docs.select("request_id", "seg_idx", "id").join(cut, "id").drop("id")
    return with_hashes(segs.join(found, ["request_id", "seg_idx"], "left").withColumn("text", F.when(F.length("cut") < F.length("text"), F.col("cut")).otherwise(F.col("text"))))


def pass_s5(segs: DataFrame, keep: int, depth: int, tokens: int, gentle: DataFrame | None) -> DataFrame:
    """Old turns of conversations of ``depth`` groups and ``tokens`` tokens become a ledger; those of ``gentle`` requests (request_id) keep their
    richest turns."""
    size = segs.groupBy("request_id").agg(F.sum("token_count").alias("n")).where(F.col("n") >= tokens).select("request_id")
    grouped = ledger.turn_groups(segs.join(size, "request_id", "left_semi"))
    deep = grouped.groupBy("request_id").agg(F.max("turn_group").alias("g")).where(F.col("g") >= depth).select("request_id")
    grouped = grouped.join(deep, "request_id", "left_semi")
    old = ledger.aging(grouped, keep)
    rows = ledger.entries(grouped, keep)
    if gentle is not None:
        rich = ledger.exemplars(grouped).join(gentle, "request_id", "left_semi")
        old, rows = (df.join(rich, ["request_id", "seg_idx"], "left_anti") for df in (old, rows))
    none = old.select("request_id").distinct().select("request_id", F.lit("«Conversation ledger: decisions=[none], facts=[none], open=[none]»").alias("empty"))
    texts = none.join(ledger.formatted(rows), "request_id", "left").select("request_id", F.coalesce("ledger", "empty").alias("ledger"))
    return with_hashes(ledger.replace_old(segs.select(*COLUMNS, "segment_hash", "token_count"), old, texts))


def pass_s4(segs: DataFrame, queries: DataFrame, min_tokens: int) -> DataFrame:
    again = documents.repeats(segs.where("segment_type = 'RETRIEVED_DOC'"), ["request_id"], "seg_idx").where((F.col("repeat") == 1) & (F.col("token_count") >= min_tokens)).withColumn("id", F.concat_ws(":", "request_id", "seg_idx"))
    whole = queries.where(T.has_word(F.col("query"), T.FULL_DOCUMENT)).select("request_id")
    again = again.join(whole, "request_id", "left_anti")
    asked = again.select("id", "request_id").join(queries, "request_id").select("id", "query")
    new = documents.replacement(window.chunk_scores(window.chunks(again, "id"), asked), again.select("id", "doc_hash", T.title_guess(F.col("text")).alias("title"))).withColumnRenamed("text", "new")
    found = again.select("request_id", "seg_idx", "id").join(new, "id").drop("id")
    return with_hashes(segs.join(found, ["request_id", "seg_idx"], "left").withColumn("text", F.coalesce("new", "text")))


def pass_s7(segs: DataFrame, items: DataFrame, opted: DataFrame, budget: int) -> DataFrame:
    """Rare words of opted-in requests (request_id) that are over the budget still, in their segments of low density."""
    over = segs.groupBy("request_id").agg(F.sum("token_count").alias("n")).where(F.col("n") > budget).select("request_id")
    rows = segs.join(over, "request_id", "left_semi").join(opted, "request_id", "left_semi").where("segment_type <> 'SYSTEM_INSTRUCTION'")
    rows = rows.where(P.semantic_density("text") < lossy.MAX_DENSITY).withColumn("id", F.concat_ws(":", "request_id", "seg_idx"))
    values = rows.select("id", "request_id").join(items.groupBy("request_id").agg(F.collect_set("value").alias("values")), "request_id").select("id", "values")
    new = lossy.drop_rare(rows.select("id", "text"), values).select("id", F.col("text").alias("new"))
    found = rows.select("request_id", "seg_idx", "id").join(new, "id").drop("id")
    return with_hashes(segs.join(found, ["request_id", "seg_idx"], "left").withColumn("text", F.coalesce("new", "text")))


def optimise(segs: DataFrame, queries: DataFrame, opted: DataFrame, routes: DataFrame | None = None, prefixes: DataFrame | None = None, gentle: DataFrame | None = None, doc_budget: int = 6000, mass: float = 0.90, keep: int = 6, depth: int = ledger.MIN_DEPTH, min_turns: int = ledger.MIN_TOKENS, min_doc: int = 2000, lossy_budget: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(outcomes, segments): per request the tokens before and after, the pass whose undoing was enough ('none', or 'raw' if nothing was),
    and the segments that are left.

    ``routes``: (request_id, strategy, status); a pass leaves requests alone for which it is DISABLED. ``prefixes``: see prefix_guard. Every
    version is checkpointed, so plans stay small and no pass runs twice.
    """
    base = saved(with_hashes(segs))
    items = saved(manifest.extract(base))
    versions = [base]
    passes = {
        "S2": lambda v: with_hashes(v.withColumn("text", F.when(F.col("segment_type") == "SYSTEM_INSTRUCTION", fillers.strip_fillers(F.col("text"))).otherwise(F.col("text")))),
        "S1": lambda v: pass_s1(v, items),
        "S6": pass_s6,
        "S3": lambda v: pass_s3(v, queries, items, doc_budget, mass),
        "S5": lambda v: pass_s5(v, keep, depth, min_turns, gentle),
        "S4": lambda v: pass_s4(v, queries, min_doc),
        "S7": lambda v: pass_s7(v, items, opted, lossy_budget),
    }
    barred = None if routes is None else saved(routes.where(F.col("status") == "DISABLED").select("request_id", "strategy").distinct())
    for name in gate.RUN_ORDER:
        before = versions[-1]
        off = None if barred is None else barred.where(F.col("strategy") == name).select("request_id")
        some = before if off is None else before.join(off, "request_id", "left_anti")
        after = passes[name](some).select(*base.columns)
        if name in ("S1", "S2", "S6"):
            after = prefix_guard(some, after, prefixes).select(*base.columns)
        versions.append(saved(after if off is None else after.unionByName(before.join(off, "request_id", "left_semi"))))

    def attempt(stage: str, k: int) -> DataFrame:
        texts = joined_texts(versions[k], name="text")
        cover = manifest.coverage(items, base.select("request_id").distinct().join(texts, "request_id", "left").fillna("", ["text"]))
        guard = manifest.polarity_intact(items, versions[k])
        scored = cover.join(guard, "request_id", "left")
        one = F.lit(1.0)
        return scored.select("request_id", F.lit(stage).alias("stage"), gate.quality(F.col("coverage"), F.coalesce("intact", F.lit(0)) == 1, one, one, one).alias("qps"), gate.floor(F.lit(stage == "none")).alias("floor"))

    chosen = saved(gate.rollback(reduce(DataFrame.unionByName, (attempt(s, k) for s, k in SNAPSHOTS.items()))))
    place = F.create_map(*(F.lit(x) for pair in {**SNAPSHOTS, "raw": 0}.items() for x in pair))
    kept = chosen.select("request_id", "stage", place[F.col("stage")].alias("version"))
    out = reduce(DataFrame.unionByName, (versions[k].join(kept.where(F.col("version") == k).select("request_id"), "request_id", "left_semi") for k in sorted({0, *SNAPSHOTS.values()})))
    tokens = lambda df, name: df.groupBy("request_id").agg(F.sum("token_count").alias(name))
    result = kept.join(tokens(base, "tokens_before"), "request_id").join(tokens(out, "tokens_after"), "request_id", "left")
    # A result that is no smaller than the request is not used.
    smaller = F.coalesce("tokens_after", F.lit(0)) < F.col("tokens_before")
    return result.select("request_id", F.when(smaller, F.col("stage")).otherwise("raw").alias("stage"), "tokens_before", F.when(smaller, F.coalesce("tokens_after", F.lit(0))).otherwise(F.col("tokens_before")).alias("tokens_after")), out
