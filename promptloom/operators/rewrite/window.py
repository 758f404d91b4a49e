"""S3: relevance windows over long documents. S4 uses its chunks too."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ...functions import arrow as P, text as T

CHUNK, STEP = 256 * 4, (256 - 32) * 4
K1, B = 1.5, 0.75
WEIGHT_COSINE, WEIGHT_BM25, WEIGHT_PLACE = 0.7, 0.2, 0.1


def applies(tokens: Column, budget: Column, has_document: Column, status: Column) -> Column:
    return has_document & (tokens > budget * 1.5) & (status != "DISABLED")


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = CHUNK, step: int = STEP) -> DataFrame:
    """(id, chunk_idx, n_chunks, chunk, tokens): windows of ``size`` characters every ``step``."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / step) - 1).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), (last + 1).alias("n_chunks"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    piece = F.substring("text", F.col("chunk_idx") * step + 1, F.lit(size))
    return rows.select("id", "chunk_idx", "n_chunks", piece.alias("chunk"), T.token_estimate(piece).alias("tokens"))


def lexical(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, chunk_idx, bm25, cosine) of parts (id, chunk_idx, chunk) for their id's query (id, query), repeated query terms counted each time;
    an id without a query has zeros.

    Chunks go to their id once, sorted, and one pass makes all numbers; it holds the counts of one document's chunks.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select("id", "chunk_idx", "chunk").repartition(n, "id").join(queries.select("id", "query").repartition(n, "id"), "id", "left")
    kind = parts.schema["id"]

    def scored(held: list[tuple], terms: Counter) -> Iterator[float]:
        mean = max(1.0, sum(size for _, size, _, _ in held) / len(held))
        df = Counter(t for _, _, tf, _ in held for t in tf)
        weight = {t: terms[t] * log((len(held) - df[t] + 0.5) / (df[t] + 0.5) + 1) * (K1 + 1) for t in df}
        for _, size, tf, _ in held:
            yield sum((weight[t] * n / (n + K1 * (1 - B + B * size / mean)) for t, n in tf.items()), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, terms, bag = None, [], Counter(), Counter()

        def done(id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([key] * len(held), id_type), pa.array([h[0] for h in held], pa.int32()), pa.array(list(scored(held, terms)), pa.float64()), pa.array([h[3] for h in held], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "chunk_idx", "bm25", "cosine"])

        for batch in batches:
            id_type = batch.column(0).type
            for own, idx, chunk, query in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key or not held:
                    if held:
                        yield done(id_type)
                    low = (query or "").lower()
                    key, held, terms, bag = own, [], Counter(P.split_words(low)), Counter(P.LETTERS.findall(low))
                low = (chunk or "").lower()
                words = P.split_words(low)
                held.append((idx, len(words), Counter(filter(terms.__contains__, words)), P.counts_cosine(bag, Counter(P.LETTERS.findall(low)))))
        if held:
            yield done(id_type)

    out = StructType([StructField("id", kind.dataType), StructField("chunk_idx", IntegerType()), StructField("bm25", DoubleType()), StructField("cosine", DoubleType())])
    return rows.sortWithinPartitions("id", "chunk_idx").mapInArrow(run, out)


def bm25(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, chunk_idx, bm25), see ``lexical``."""
    return lexical(parts, queries).select("id", "chunk_idx", "bm25")


def position_prior(idx: Column, n: Column) -> Column:
    """1 for the first and last chunk and those next to them, falling to 0.3 in the middle."""
    inner = F.least(idx, n - 1 - idx) - 1
    share = inner / F.greatest((n - 1) / 2 - 1, F.lit(1.0))
    return F.when(inner < 0, F.lit(1.0)).otherwise(1.0 - share * 0.7)


def chunk_scores(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, chunk_idx, tokens, score) of weighted cosine, BM25 (against the id's best) and place."""
    best = Window.partitionBy("id")
    found = lexical(parts, queries).withColumn("top", F.max("bm25").over(best))
    rows = parts.join(found, ["id", "chunk_idx"]).join(queries.select("id"), "id", "left_semi")
    share = F.when(F.col("top") > 0, F.col("bm25") / F.col("top")).otherwise(F.lit(0.0))
    score = WEIGHT_COSINE * F.col("cosine") + WEIGHT_BM25 * share + WEIGHT_PLACE * position_prior(F.col("chunk_idx"), F.col("n_chunks"))
    return rows.select("id", "chunk_idx", "n_chunks", "tokens", "chunk", score.alias("score"))


def top_mass(scored: DataFrame, floor: float, items: DataFrame | None = None) -> DataFrame:
    """Chunks kept: best first until their tokens reach ``floor`` of all and, with ``items`` (id, value), every value is in a kept one. A value
    that no chunk has keeps all."""
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "chunk_idx")
    rows = scored.withColumn("rank", F.row_number().over(order)).withColumn("mass", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("tokens").over(Window.partitionBy("id")))
    enough = rows.groupBy("id").agg(F.min(F.when(F.col("mass") >= floor * F.col("total"), F.col("rank"))).alias("stop"))
    if items is not None:
        held = items.join(rows.select("id", "rank", "chunk"), "id").groupBy("id", "value").agg(F.min(F.when(F.contains("chunk", F.col("value")), F.col("rank"))).alias("first"))
        cover = held.groupBy("id").agg(F.max(F.coalesce("first", F.lit(1 << 30))).alias("cover"))
        enough = enough.join(cover, "id", "left").select("id", F.greatest("stop", F.coalesce("cover", F.lit(0))).alias("stop"))
    return rows.join(enough, "id").withColumn("kept", F.col("rank") <= F.col("stop")).drop("mass", "total", "stop")


def force_neighbours(kept: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks next to a kept one (one step) that share a word of four characters or more with a governing span (id, span) are kept too."""
    order = Window.partitionBy("id").orderBy("chunk_idx")
    words = spans.select("id", F.explode(F.filter(T.words(F.lower("span")), lambda w: F.length(w) >= 4)).alias("w")).groupBy("id").agg(F.collect_set("w").alias("span_words"))
    rows = kept.withColumn("beside", F.coalesce(F.lag("kept").over(order), F.lit(False)) | F.coalesce(F.lead("kept").over(order), F.lit(False)))
    rows = rows.join(words, "id", "left")
    touches = F.exists("span_words", lambda w: F.contains(F.lower("chunk"), w))
    return rows.withColumn("kept", F.col("kept") | (F.col("beside") & F.coalesce(touches, F.lit(False)))).drop("beside", "span_words")


def reassemble(kept: DataFrame) -> DataFrame:
    """(id, text): kept chunks in order, a mark at each gap."""
    order = Window.partitionBy("id").orderBy("chunk_idx")
    rows = kept.where("kept").withColumn("gap", F.coalesce(F.col("chunk_idx") - F.lag("chunk_idx").over(order) > 1, F.lit(False)))
    piece = F.concat(F.when(F.col("gap"), F.lit("[…]\n")).otherwise(F.lit("")), F.col("chunk"))
    return rows.select("id", "chunk_idx", piece.alias("piece")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "piece"))), lambda r: r["piece"]), "\n").alias("text"))
