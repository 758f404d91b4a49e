"""Connected components of a table of edges."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share; only where it is unset and they are one process, a
    temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the smallest node of the component.

    Every node takes the smallest label of its neighbours, then its label's label; this halves distances, so long chains end soon.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        moved = labels.join(near, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = saved(moved.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "old"))
        labels = moved.select("node", "root")
        if not moved.where("root <> old").limit(1).count():
            return labels
