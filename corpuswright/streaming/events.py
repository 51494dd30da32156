"""Incremental plans on Structured Streaming; every plan is a function that batch queries use too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame) -> DataFrame:
    """(start, event_type, n, total) of each hour; works on a batch and on a stream."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, lateness: str = "1 hour", files: int = 8) -> DataFrame:
    """Events as files arrive, each event_id once within the lateness bound; later rows are dropped and
    the state of passed hours with them."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def ingest_texts(spark: SparkSession, folder: str, schema, transform, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through ``transform`` (a batch function) and into ``target``, one folder a batch.

    The batch number names the folder and a repeated batch overwrites it: exactly-once output after a
    restart.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
