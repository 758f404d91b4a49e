"""Benchmark results: latest rows, workload aggregates, scorers and cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .gate import set_jaccard

VOLUMES = [100_000, 1_000_000, 10_000_000, 100_000_000]
INPUT_SHARE, DAYS = 0.75, 30


def latest(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one pre-aggregated maximum."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def reduction(saved: Column, tokens_in: Column) -> Column:
    return F.when(tokens_in <= 0, F.lit(0.0)).otherwise(saved / (tokens_in + saved))


def workload_stats(results: DataFrame) -> DataFrame:
    """(workload, provider, ...) means of optimised runs against baseline runs; failed rows do not count."""
    good = results.where("error IS NULL")
    is_run, is_base = F.col("run_type") == "optimised", F.col("run_type") == "baseline"
    when = lambda test, c: F.when(test, F.col(c))
    out = good.groupBy("workload", "provider").agg(
        F.count_if(is_base).alias("n_baseline"), F.count_if(is_run).alias("n_run"),
        F.sum(F.when(is_run, F.floor(F.col("tokens_saved") * 1_000_000 / (F.col("tokens_in") + F.col("tokens_saved"))))).alias("reduction_ppm"),
        F.sum(when(is_base, "latency_ms")).alias("latency_base"), F.sum(when(is_run, "latency_ms")).alias("latency_run"),
        F.count_if(is_run & F.col("cache_tier").isin("l0", "l1", "l2")).alias("hits"), F.sum(when(is_base, "cost_micros")).alias("cost_base"), F.sum(when(is_run, "cost_micros")).alias("cost_run"),
    )
    mean = lambda total, n: F.round(F.col(total) / F.nullif(F.col(n), F.lit(0)), 4)
    return out.select("workload", "provider", "n_baseline", "n_run", mean("reduction_ppm", "n_run").alias("reduction_ppm"), mean("latency_base", "n_baseline").alias("latency_baseline"), mean("latency_run", "n_run").alias("latency_run"), mean("hits", "n_run").alias("cache_hit_rate"), F.greatest(F.lit(0), F.coalesce("cost_base", F.lit(0)) - F.coalesce("cost_run", F.lit(0))).alias("saved_micros"))


def bootstrap(values: DataFrame, keys: list[str], resamples: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(keys, mean, lo, hi) of (keys, id, value): a Poisson bootstrap, whose weights come from hashes of id and resample.

    Every row adds its weighted value to all resamples in one pre-aggregation, so nothing is resampled by position and the result does
    not depend on the partitions.
    """
    rounds = values.select(*keys, "value", "id", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    u = (F.pmod(F.xxhash64("id", "b"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]  # cumulative Poisson(1) probabilities
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    means = rounds.groupBy(*keys, "b").agg((F.sum(weight * F.col("value")) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    bounds = means.groupBy(*keys).agg(F.percentile("m", F.lit(low)).alias("lo"), F.percentile("m", F.lit(high)).alias("hi"))
    return values.groupBy(*keys).agg(F.avg("value").alias("mean")).join(bounds, keys)


def sample_cards(results: DataFrame, n: int = 15) -> DataFrame:
    """The runs with the greatest savings, then the least quality, with their baseline's latency: ``n`` a workload."""
    runs = results.where("run_type = 'optimised' AND error IS NULL")
    base = results.where("run_type = 'baseline' AND error IS NULL").select("workload", "provider", "sample_id", F.col("latency_ms").alias("baseline_latency"))
    order = Window.partitionBy("workload", "provider").orderBy(F.col("tokens_saved").desc(), "quality_milli", "sample_id")
    top = runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return top.join(base, ["workload", "provider", "sample_id"], "left").select("workload", "provider", "sample_id", "place", "tokens_saved", "baseline_latency")


def scale_table(prices: DataFrame, savings: float) -> DataFrame:
    """Monthly cost with and without savings at four daily volumes."""
    volumes = prices.select("provider", "input_price", "output_price", F.explode(F.array(*(F.lit(v).cast("long") for v in VOLUMES))).alias("tokens_per_day"))
    monthly = F.col("tokens_per_day") * DAYS
    cost = (F.floor(monthly * INPUT_SHARE) * F.col("input_price") + (monthly - F.floor(monthly * INPUT_SHARE)) * F.col("output_price")) / 1e6
    return volumes.select("provider", "tokens_per_day", F.round(cost, 4).alias("cost"), F.round(cost * (1 - savings), 4).alias("cost_saved"))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Of token sets over list lengths."""
    p, g = T.answer_tokens(prediction), T.answer_tokens(gold)
    common = F.size(F.array_intersect(p, g))
    both_empty = ((F.size(p) == 0) & (F.size(g) == 0)).cast("double")
    return F.when((F.size(p) == 0) | (F.size(g) == 0), both_empty).when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (F.array_join(T.answer_tokens(prediction), " ") == F.array_join(T.answer_tokens(gold), " ")).cast("double")


def bigrams(tokens: Column) -> Column:
    """Distinct neighbour pairs; a single token stands for itself."""
    pairs = F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(tokens) >= 2, pairs).otherwise(tokens))


def bigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(bigrams(T.answer_tokens(a)), bigrams(T.answer_tokens(b)))


def length_ok(a: Column, b: Column) -> Column:
    size = lambda x: F.greatest(F.lit(1), F.size(T.words(x)))
    return (size(a) / size(b)).between(0.5, 2.0).cast("double")


def entity_coverage(response: Column, entities: Column) -> Column:
    low = F.lower(response)
    return F.when(F.size(entities) == 0, F.lit(1.0)).otherwise(F.size(F.filter(entities, lambda e: F.contains(low, F.lower(e)))) / F.size(entities))


def refusal_match(a: Column, b: Column) -> Column:
    return (T.has_word(a, T.REFUSALS) == T.has_word(b, T.REFUSALS)).cast("double")


def workload_score(workload: Column, new: Column, old: Column, gold: Column, entities: Column, cache_hit: Column) -> Column:
    """Score of one response by its workload's rule."""
    j, length, refuse = bigram_jaccard(new, old), length_ok(new, old), refusal_match(new, old)
    chat = 0.6 * j + 0.2 * length + 0.2 * refuse
    rag = F.when(gold.isNotNull(), F.greatest(exact_match(new, gold), token_f1(new, gold) * 0.9, chat * 0.95)).otherwise(chat)
    agent = 0.5 * entity_coverage(new, entities) + 0.35 * j + 0.15 * length
    faq = F.when(cache_hit, F.when(T.strip(new) == T.strip(old), 1.0).otherwise(0.7)).otherwise(j)
    return F.when(workload == "rag", rag).when(workload == "agent", agent).when(workload == "faq", faq).otherwise(chat)
