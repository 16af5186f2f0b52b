"""Live monitoring of an event or trace table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import ensure_checkpoints

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows of event time, with a watermark; for batches and streams alike."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of events, read as a stream until what is there is used up. Each micro-batch writes the windows that it changed into a folder of its own, so that a batch that is run
    again replaces its rows; the result is each window's latest row. State ends as the watermark passes; nothing is collected on the driver."""
    stream = spark.readStream.schema(EVENTS).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet*")
    ensure_checkpoints(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/windows-{uuid.uuid4().hex}"

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = window_counts(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, total double, batch long").parquet(f"{folder}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 4).alias("total"))


def last_states(trace: DataFrame) -> DataFrame:
    """(chain_id, step, n_cut): of a stream or table of chain steps, each chain's latest."""
    return trace.groupBy("chain_id").agg(F.max("step").alias("step"), F.max_by("n_cut", "step").alias("n_cut"))
