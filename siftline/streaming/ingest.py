"""Pages as a stream: each new file of pages becomes chunks, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.quality import chunked
from siftline.sources.tables import page_texts


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunk_stream(pages: DataFrame, limit: int = 12000) -> DataFrame:
    """(url, pub_date, chunk_idx, text); stateless, so that no watermark is needed."""
    return chunked(page_texts(pages), limit=limit).select("url", "pub_date", "chunk_idx", "text")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends new pages' chunks to a Parquet table; a restart goes on from the checkpoint."""
    rows = chunk_stream(page_stream(spark, folder))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts by type of events (ts, event_type), late ones within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
