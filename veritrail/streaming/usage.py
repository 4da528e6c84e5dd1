"""Incremental forms: an append log, usage per case as state, and runs that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def usage_by_case(events: DataFrame) -> DataFrame:
    """Calls, tokens and wall time of each case so far; the same on a batch and on a stream."""
    tokens = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0))
    return events.groupBy(F.col("user_id").alias("qid")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum("value").alias("wall_time"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts by event time and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every row once, as JSON lines; a restart goes on where the checkpoint says."""
    return rows.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
