"""Event-time windows and stateful operators over streams of the request log.

Each takes a streaming (or batch) DataFrame and returns one; ``drain`` runs a stream over what its source has now and gives the result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder
from ..operators.sequential import Breaker

STATE = "samples array<long>, violations int, last double, state string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The event table's files as they appear. A pattern for the path lets the table be one file as well as a folder of files."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def hourly(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and saved tokens of each hour of event time; rows later than the watermark are dropped by the engine in append mode."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("tokens_saved").alias("tokens_saved"))


def first_seen(log: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose key has not come before within the watermark: what a cache would have to store."""
    return log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def breaker(log: DataFrame) -> DataFrame:
    """(request_id, cell, state) of log (request_id, cell, at seconds, parity_bp): the state of a cell is its last samples and violations.

    The rows of one trigger are put in order; across triggers the order is arrival.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Breaker()
        if state.exists:
            samples, own.violations, own.last, own.state = state.get
            own.samples.extend(samples)
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"])
        rows["state"] = [own.add(float(at), int(p)) for at, p in zip(rows["at"], rows["parity_bp"], strict=True)]
        state.update((list(own.samples), own.violations, own.last, own.state))
        yield rows[["request_id", "cell", "state"]]

    grouped = log.select("request_id", "cell", F.col("at").cast("double").alias("at"), "parity_bp").groupBy("cell")
    return grouped.applyInPandasWithState(run, "request_id long, cell string, state string", STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that its source has, into a table in the shared folder, and reads that.

    A trigger writes a folder of its own number, so that one that runs again after a failure takes its own place; in complete mode each
    trigger's result takes the place of the one before.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/trigger={0 if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/trigger=-1")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
