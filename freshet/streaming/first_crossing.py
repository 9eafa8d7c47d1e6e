"""Depth frames as a stream (an extension): first crossing of each cell, closures that only grow, stillness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "r INT, c INT, t_s INT, depth INT"


def frames(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_crossing(stream: DataFrame, limit: int) -> DataFrame:
    """(r, c, arrival_s) as soon as it is known. The minimum is exact whatever the order of frames; state is one number a cell."""
    return stream.filter(F.col("depth") >= limit).groupBy("r", "c").agg(F.min("t_s").alias("arrival_s"))


def hourly_peak(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Greatest depth in each window of simulated time; frames later than the watermark are left out and state is dropped."""
    timed = stream.withColumn("ts", F.timestamp_seconds("t_s")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.max("depth").alias("peak"), F.count("*").alias("n"))


def run_once(result: DataFrame, name: str, checkpoint: str, mode: str = "update") -> None:
    """Everything that is there now, into a table in memory."""
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
