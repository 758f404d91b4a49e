"""Cosine search within namespaces: every query against all rows of its namespace."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries of one pass, so that what is broadcast has a fixed size.
BLOCK = 4096
FOUND = "query_id long, vec_id long, cosine double"


def unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size > 0, size, 1)


def usable(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))


def neighbours(data: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, cosine) of rows (vec_id, namespace, embedding): the ``k`` best a query (ties to the smaller vec_id) or all of at least
    ``least``, without the query itself. A task keeps k rows a query; only these are shuffled. Vectors that are null, or hold a null or non-finite component,
    take no part; vectors of unequal length never meet."""
    session = data.sparkSession
    data = data.select("vec_id", F.col("namespace").cast("string").alias("namespace"), "embedding").where(usable(F.col("embedding")))
    asked = queries.select("vec_id", F.col("namespace").cast("string").alias("namespace"), "embedding").where(usable(F.col("embedding")))

    def scan(rows: list) -> DataFrame:
        held = session.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_space: dict[tuple, list] = {}
            for vec_id, space, vector in held.value:
                by_space.setdefault((space, len(vector)), []).append((vec_id, vector))
            sides = {s: (np.array([i for i, _ in v]), unit(np.array([x for _, x in v], dtype=np.float64))) for s, v in by_space.items()}
            best = {s: [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids) for s, (ids, _) in sides.items()}
            for batch in batches:
                names, vectors = batch.column(0).to_numpy(), batch.column(2).to_pylist()
                places: dict[tuple, list[int]] = {}
                for place, (space, vector) in enumerate(zip(batch.column(1).to_pylist(), vectors, strict=True)):
                    places.setdefault((space, len(vector)), []).append(place)
                for s, (ids, matrix) in sides.items():
                    rows_ = np.array(places.get(s, []), dtype=np.int64)
                    if not len(rows_):
                        continue
                    scores = matrix @ unit(np.array([vectors[p] for p in rows_], dtype=np.float64)).T
                    for q in range(len(ids)):
                        keep = names[rows_] != ids[q]
                        if least is not None:
                            keep &= scores[q] >= least
                        value, name = np.append(best[s][q][0], scores[q][keep]), np.append(best[s][q][1], names[rows_][keep])
                        if k is not None:
                            top = np.lexsort((name, -value))[:k]
                            best[s][q] = (value[top], name[top])
                        elif len(value):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), ids[q])), pa.array(name), pa.array(value)], names=["query_id", "vec_id", "cosine"])
            if k is not None:
                for s, (ids, _) in sides.items():
                    sizes = [len(v) for v, _ in best[s]]
                    if sum(sizes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([n for _, n in best[s]])), pa.array(np.concatenate([v for v, _ in best[s]]))], names=["query_id", "vec_id", "cosine"])

        return data.mapInArrow(run, FOUND)

    passes, rows = [], []
    for row in asked.toLocalIterator():
        rows.append(tuple(row))
        if len(rows) == block:
            passes.append(scan(rows))
            rows = []
    if rows or not passes:
        passes.append(scan(rows))
    found = reduce(DataFrame.union, passes)
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
