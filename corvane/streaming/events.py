"""Event logs as streams. The windowed count is an extension; the fixed lifetime follows the batch rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_LOG = "time_unix double, event string, payload map<string, string>"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_LOG) -> DataFrame:
    """A stream of the JSON lines appended under ``path``."""
    return spark.readStream.schema(schema).json(path)


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table read as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events and value sums by type and window; rows later than ``lateness`` behind the greatest time seen are dropped, null times too."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def expires_at(created: Column, ttl_seconds: float) -> Column:
    """End of a session's fixed lifetime; use does not extend it."""
    return created + F.make_dt_interval(secs=F.lit(float(ttl_seconds)))


def access_expired(created: Column, ttl_seconds: float, at: Column) -> Column:
    """Access ends when the lifetime does: at its end it is over."""
    return expires_at(created, ttl_seconds) <= at


def cleanup_due(touched: Column, ttl_seconds: float, at: Column) -> Column:
    """Cleanup goes by the last change and is due only after the lifetime, not at its end."""
    return expires_at(touched, ttl_seconds) < at


def run_to_files(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result, which stays in the folder ``path`` and never goes through the driver.

    In ``complete`` mode each batch replaces the one before; in the other modes
    batches are appended, a batch that is tried again replacing its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data" if mode == "complete" else f"{path}/data/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
