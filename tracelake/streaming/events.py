"""Event-time windows over the events table: native streaming, beside what the transcript engine needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import scratch


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) per window, with late rows dropped behind the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def run_to_end(spark: SparkSession, path: str, query, mode: str = "complete") -> DataFrame:
    """The result of a streaming query over the rows that are at path now, read from a Parquet sink."""
    schema = spark.read.parquet(path).schema
    base = scratch(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream's source is a folder: this file's, with no other file of it
        folder, _, name = path.rpartition("/")
        stream = query(reader.option("pathGlobFilter", name).parquet(folder))
    else:
        stream = query(reader.parquet(path))
    out = f"{base}/out"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = stream.writeStream.queryName(f"q{uuid.uuid4().hex}").outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
