"""Exact top-k inner products with vector-approximation files.

1. ``approximation_file``: each dimension is cut at quantiles (of a bounded sample: they decide how tight bounds are, never a result)
   into 2**BITS cells; a vector is its row of cells, a byte a dimension. The least and greatest value of each cell come from all
   vectors. The cells are written once, to the shared folder, beside the table of exact vectors.
2. ``candidates``: for a block of queries the cells alone are scanned. They give an upper and a lower bound of every inner product (for a
   score, the upper bound is what the lower bound is for a distance). A vector stays only if its upper bound reaches the kth best lower
   bound, of its task and then of all; with equal bounds a smaller vec_id decides, as it does in the result.
3. ``read_exact``: the exact vectors of the candidates alone are joined to them, and read in the order of the upper bound until the
   kth exact score is certain.

Scale: the query set is taken in blocks of QUERY_BYTES at most; each is one broadcast, one scan of the cells and one of the ids of
the exact vectors, and its result is written before the next block is collected, so the driver never holds more. A task sends about
k candidates a query. A worker holds TILE x STEP bounds (24 MB with their temporaries) and the cells of one step.

Cases: vectors that are null, or hold a null or non-finite component, take no part (as a query they give no rows);
vectors of another length than the query's are no candidates; rows with the query's own vec_id are the query's own;
a query vec_id that repeats is asked once, with its smallest vector; a vec_id that repeats is a candidate each time; null vec_ids are no
candidates; ties go to the smaller vec_id; fewer than k candidates give all; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import partitions, shared_folder

K, BITS = 5, 8
#: Vectors that the quantiles are taken of; bytes of a block of queries; queries and vectors whose bounds are held at once.
SAMPLE, QUERY_BYTES, TILE, STEP = 4096, 4 << 20, 128, 4096
CELLS = "vec_id long, rk long, size int, cells binary"
NEAR = "query_id long, vec_id long, rk long, upper double, lower double"


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null where the vector can't take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & ~bad, whole)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products as int64: by doubles where these are exact, else by int64 arithmetic."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[-1])
    if most < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    return queries @ data.T


def matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Some rows of a column of lists that have ``size`` members each."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The lengths of lists, and the rows that have them."""
    lengths = np.diff(column.offsets.to_numpy())
    for size in np.unique(lengths).tolist():
        yield size, np.flatnonzero(lengths == size)


def cuts_of(data: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """By vector length: the quantiles (cuts x dimensions) of a sample of SAMPLE vectors at most."""
    rows = data.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).collect()
    out = {}
    for size in {len(r.vector) for r in rows}:
        own = [r.vector for r in rows if len(r.vector) == size]
        some = np.array(own, dtype=np.int64).reshape(len(own), size)
        out[size] = np.quantile(some, np.arange(1, 1 << bits) / (1 << bits), axis=0, method="lower") if size else np.zeros((0, 0))
    return out


def cells_of(vectors: np.ndarray, cuts: np.ndarray | None) -> np.ndarray:
    """Cell numbers; without cuts (a length that the sample lacks) all are cell 0."""
    out = np.zeros(vectors.shape, dtype=np.uint8)
    if cuts is not None:
        for d in range(vectors.shape[1]):
            out[:, d] = np.searchsorted(cuts[:, d], vectors[:, d], side="left")
    return out


def approximation_file(data: DataFrame, folder: str, bits: int = BITS) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The written cells of (vec_id, rk, vector), and by length the least and greatest values of the cells (cells x dimensions)."""
    session = data.sparkSession
    cuts = session.sparkContext.broadcast(cuts_of(data, bits))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, vectors = batch.column(0), batch.column(1), batch.column(2)
            for size, rows in by_size(vectors):
                for at in range(0, len(rows), STEP):
                    part = rows[at : at + STEP]
                    cells = cells_of(matrix(vectors, part, size), cuts.value.get(size))
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(np.full(len(part), size, dtype=np.int32)), pa.array([c.tobytes() for c in cells], pa.binary())], names=["vec_id", "rk", "size", "cells"])

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(0)
            for size, rows in by_size(vectors):
                if size not in low:
                    low[size] = np.full((1 << bits, size), np.iinfo(np.int64).max)
                    high[size] = np.full((1 << bits, size), np.iinfo(np.int64).min)
                for at in range(0, len(rows), STEP):
                    values = matrix(vectors, rows[at : at + STEP], size)
                    cells, dims = cells_of(values, cuts.value.get(size)), np.arange(size)
                    np.minimum.at(low[size], (cells, dims), values)
                    np.maximum.at(high[size], (cells, dims), values)
        for size in low:
            for cell in np.flatnonzero((low[size] <= high[size]).any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([cell], pa.int32()), pa.array([low[size][cell].tolist()], pa.list_(pa.int64())), pa.array([high[size][cell].tolist()], pa.list_(pa.int64()))], names=["size", "cell", "low", "high"])

    # A row for each task, length and cell, merged before they come here: 2**BITS rows a length.
    found = data.select("vector").mapInArrow(extremes, "size int, cell int, low array<long>, high array<long>")
    wide = found.where("size > 0").select("size", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("d", "v"))
    merged = wide.groupBy("size", "cell", "d").agg(F.min("v.low").alias("low"), F.max("v.high").alias("high"))
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in merged.toLocalIterator():
        if r.size not in edges:
            edges[r.size] = np.zeros((1 << bits, r.size)), np.zeros((1 << bits, r.size))
        if r.low <= r.high:  # else the cell is empty in this dimension
            edges[r.size][0][r.cell, r.d], edges[r.size][1][r.cell, r.d] = r.low, r.high
    data.mapInArrow(code, CELLS).write.parquet(folder)
    return session.read.parquet(folder), edges


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and vector two values that the inner product lies between (rounding included)."""
    dims, q = np.arange(cells.shape[1]), queries.astype(np.float64)
    least, most = low[cells, dims], high[cells, dims]
    upper = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    lower = upper - np.abs(q) @ (most - least).T
    room = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).max(axis=0, initial=0))[:, None]
    # Whole numbers below 2**53 are exact; larger ones get room for rounding.
    room = np.where(room < 2**50, 0.0, room * 1e-11)
    return upper + room, lower - room


class Nearest:
    """The candidates of one block's queries of one length, over the steps of a task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[np.ndarray]] = [[] for _ in ids]  # parts of (vec_id, rk) and (upper, lower)
        self.floor = np.full(len(ids), -np.inf)
        self.last = np.full(len(ids), np.iinfo(np.int64).max)

    def add(self, names: np.ndarray, keys: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for at in range(0, len(self.ids), TILE):
            upper, lower = bounds(self.queries[at : at + TILE], cells, low, high)
            for q in range(at, min(at + TILE, len(self.ids))):
                up = upper[q - at]
                near = np.flatnonzero((up > self.floor[q]) | ((up == self.floor[q]) & (names <= self.last[q])))
                near = near[names[near] != self.ids[q]]
                if len(near):
                    self.keep(q, names[near], keys[near], up[near], lower[q - at][near])

    def keep(self, q: int, names: np.ndarray, keys: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        names, keys, upper, lower = (np.concatenate(v) for v in zip(*self.found[q], (names, keys, upper, lower), strict=True)) if self.found[q] else (names, keys, upper, lower)
        if len(names) >= self.k:
            best = np.flatnonzero(lower >= np.partition(lower, -self.k)[-self.k])
            best = best[np.lexsort((names[best], -lower[best]))[: self.k]]
            self.floor[q], self.last[q] = lower[best[-1]], names[best[-1]]
            stay = (upper > self.floor[q]) | ((upper == self.floor[q]) & (names <= self.last[q]))
            names, keys, upper, lower = names[stay], keys[stay], upper[stay], lower[stay]
        self.found[q] = [(names, keys, upper, lower)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        some = [(q, *f[0]) for q, f in zip(self.ids.tolist(), self.found, strict=True) if f]
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            columns = [np.repeat([p[0] for p in part], [len(p[1]) for p in part]), *(np.concatenate([p[c] for p in part]) for c in range(1, 5))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n.split()[0] for n in NEAR.split(", ")])


def candidates(file: DataFrame, edges: dict, asked, k: int) -> DataFrame:
    """NEAR rows of the vectors that may be among the k best of a query, by their cells alone."""
    edges = file.sparkSession.sparkContext.broadcast(edges)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Nearest] = {}
        for size in {len(v) for v in asked.value.values()}:
            own = [(i, v) for i, v in asked.value.items() if len(v) == size]
            state[size] = Nearest(np.array([i for i, _ in own], dtype=np.int64), np.array([v for _, v in own], dtype=np.int64).reshape(len(own), size), k)
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in set(sizes.tolist()) & set(state):
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), STEP):
                    take = pa.array(rows[at : at + STEP])
                    cells = np.frombuffer(b"".join(batch.column(3).take(take).to_pylist()), dtype=np.uint8).reshape(len(take), size)
                    low, high = edges.value.get(size, (np.zeros((1, 0)), np.zeros((1, 0))))
                    state[size].add(batch.column(0).take(take).to_numpy(), batch.column(1).take(take).to_numpy(), cells, low, high)
        for nearest in state.values():
            yield from nearest.rows()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a query by lower bound, then vec_id: those after the kth stay if their upper bound reaches it."""
        query, n, floor, last = None, 0, 0.0, 0
        for batch in batches:
            stay = []
            for q, name, upper, lower in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if q != query:
                    query, n = q, 0
                n += 1
                if n <= k:
                    floor, last = lower, name
                stay.append(n <= k or upper > floor or (upper == floor and name <= last))
            yield batch.filter(pa.array(stay, pa.bool_()))

    near = file.mapInArrow(scan, NEAR)
    return near.repartition(partitions(file), "query_id").sortWithinPartitions("query_id", F.col("lower").desc(), "vec_id").mapInArrow(best, NEAR)


def read_exact(near: DataFrame, data: DataFrame, asked, k: int, reads=None) -> DataFrame:
    """(query_id, rank, vec_id, score): exact vectors read in the order of their bounds, until the kth score is certain.

    ``reads``, an accumulator, counts the exact products."""
    rows = near.select("query_id", "vec_id", "rk", "upper").distinct().join(data, ["vec_id", "rk"]).select("query_id", "vec_id", "upper", "vector")
    rows = rows.repartition(partitions(data), "query_id").sortWithinPartitions("query_id", F.col("upper").desc(), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, best = None, []  # (-score, vec_id), best first

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.int64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            vectors = batch.column(3)
            ends, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            for at, (q, name, upper) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if q != query:
                    if best:
                        yield found()
                    query, best = q, []
                if len(best) == k and (-upper, name) > best[-1]:
                    continue
                vector = flat[ends[at] : ends[at + 1]]
                best = sorted([*best, (-int(products(np.array([asked.value[q]], dtype=np.int64), vector[None])[0, 0]), name)])[:k]
                if reads is not None:
                    reads.add(1)
        if best:
            yield found()

    return rows.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def exact_topk(data: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BYTES, reads=None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest integer inner products of each query.

    ``data`` and ``queries``: (vec_id long, vector array<long>), see ``quantise``. ``block``: bytes of the queries of one pass.
    """
    session = data.sparkSession
    folder = f"{shared_folder(session)}/topk-{uuid.uuid4().hex}"
    data = data.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", F.xxhash64("vector").alias("rk"), "vector")
    queries = queries.where("vec_id IS NOT NULL AND vector IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vector").alias("vector"))
    size = queries.agg(F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-size // block))
    queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/queries")
    queries = session.read.schema("vec_id long, vector array<long>, block int").parquet(f"{folder}/queries")
    file, edges = approximation_file(data, f"{folder}/cells")
    passes = []
    for b in range(blocks):
        asked = session.sparkContext.broadcast({r.vec_id: r.vector for r in queries.where(F.col("block") == b).collect()})
        found = read_exact(candidates(file, edges, asked, k), data, asked, k, reads)
        if blocks > 1:
            found.write.parquet(f"{folder}/found-{b}")
            found = session.read.schema(found.schema).parquet(f"{folder}/found-{b}")
            asked.destroy()
        passes.append(found)
    return reduce(DataFrame.union, passes)
