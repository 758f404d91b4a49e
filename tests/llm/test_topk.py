import numpy as np
from pyspark.sql import functions as F

from promptloom.llm import topk


def brute(rows, k):
    out = {}
    for qid, q in sorted((i, tuple(v)) for i, v in rows if i is not None and v is not None and i % 50 == 0):
        if qid in out:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i is not None and v is not None and i != qid and len(v) == len(q))
        out[qid] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def result(spark, rows, k=5, block=1 << 20):
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("query_id", F.lit("clash")).repartition(3)
    got = {}
    for r in topk.exact_topk(df, df.where("vec_id % 50 = 0"), k, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(700)] + [(5000 + i, [1, 1, 1, 1, 1, 1]) for i in range(40)]
    assert result(spark, rows) == brute(rows, 5)
    assert result(spark, rows, block=300) == brute(rows, 5)


def test_large_values_and_fewer_than_k(spark):
    rows = [(0, [2**40, -(2**20)]), (1, [2**22, 5]), (2, [-(2**22), 9])]
    assert result(spark, rows) == brute(rows, 5)


def test_awkward_rows(spark):
    rows = [(0, [1, 2]), (0, [0, 5]), (1, None), (None, [9, 9]), (2, [3, 3]), (3, [3, 3]), (4, [1, 2, 3]), (50, [])]
    assert result(spark, rows) == {0: [(1, 2, 15), (2, 3, 15)]}
    assert result(spark, []) == {}


def test_quantise(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, None), (5, [float("inf"), 0.0])], "vec_id long, e array<float>")
    got = {r.vec_id: r.v for r in df.select("vec_id", topk.quantise(F.col("e")).alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


def test_rows_that_repeat_and_a_very_common_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [2, 1, 0, 3]) for i in range(1, 400)] * 2 + [(1000 + i, rng.integers(-3, 4, 4).tolist()) for i in range(200)] + [(1050, [1, 1, 1, 1])]
    assert result(spark, rows) == brute(rows, 5)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for most in (100, 2**40):
        data, queries = rng.integers(-most, most, (500, 8)), rng.integers(-most // 2**20 - 9, most // 2**20 + 9, (20, 8))
        cuts = np.quantile(data[:100], np.arange(1, 16) / 16, axis=0, method="lower")
        cells = topk.cells_of(data, cuts)
        low, high = np.zeros((16, 8)), np.zeros((16, 8))
        for c in range(16):
            for d in range(8):
                if (own := data[cells[:, d] == c, d]).size:
                    low[c, d], high[c, d] = own.min(), own.max()
        upper, lower = topk.bounds(queries, cells, low, high)
        exact = topk.products(queries, data)
        assert (upper >= exact).all() and (lower <= exact).all() and cells.max() < 16


def test_few_exact_vectors_are_read_of_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", topk.quantise(F.col("embedding")).alias("vector"))
    queries = df.where("vec_id % 50 = 0")
    reads = spark.sparkContext.accumulator(0)
    got = topk.exact_topk(df, queries, reads=reads).collect()
    n, asked = df.count(), queries.count()
    assert len(got) == 5 * asked and 5 * asked <= reads.value < 0.03 * n * asked
