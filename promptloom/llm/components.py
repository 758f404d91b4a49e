"""Connected components of an edge table by randomised contraction, DataFrame operations only.

Each round every node moves to the neighbour (or itself) with the smallest hash under a new seed, the edges
are renamed, loops and repeats go, until none is left; the expected number of rounds is logarithmic. Minima
are pre-aggregated before the shuffle, so a node with very many edges costs one row a task; the joins that
rename edges are plain equi-joins whose hot keys adaptive execution can split. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; two nodes have one root exactly if they are connected.

    Loops and edges with a null end are ignored; no edges give no rows. Which node is the root is arbitrary.
    """
    edges = checkpoint(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels, turn = None, 0
    while edges.limit(1).count():
        turn += 1
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("w"))
        ends = F.array(F.struct(F.col("a").alias("v"), rank("b").alias("n")), F.struct(F.col("b").alias("v"), rank("a").alias("n")))
        near = edges.select(F.explode(ends).alias("e")).select("e.v", "e.n").groupBy("v").agg(F.min("n").alias("n"))
        moved = checkpoint(near.select("v", F.least(F.col("n"), rank("v")).getField("w").alias("to")))
        if labels is None:
            labels = moved.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(moved, labels.root == moved.v, "left").select("node", F.coalesce("to", "root").alias("root"))
        ends_a, ends_b = moved.select(F.col("v").alias("a"), F.col("to").alias("ra")), moved.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        edges = edges.join(ends_a, "a").join(ends_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = checkpoint(edges.where("a <> b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
