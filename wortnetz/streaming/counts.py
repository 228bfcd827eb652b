"""Counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(key, start, end, n) per tumbling window. On a stream, rows later than ``late`` are left out and state is dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(key, F.window(ts, size).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there and stops; a later call goes on from the checkpoint."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
