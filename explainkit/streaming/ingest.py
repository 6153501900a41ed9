"""Streaming extraction of statements from review files.

The checkpoint replaces skip-by-count: each file is read once whatever fails, and each micro-batch is one
atomic append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from explainkit.functions.models import StatementExtractor, extract_statements
from explainkit.sources.reviews import RAW_REVIEW, renamed


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    return renamed(spark.readStream.schema(RAW_REVIEW).option("maxFilesPerTrigger", files_per_batch).json(folder))


def extract_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, model: StatementExtractor) -> StreamingQuery:
    """Read what is there, extract, append as Parquet, and stop."""
    found = extract_statements(read_stream(spark, folder), model)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each event type by window, closed by a watermark; also right on a batch table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "event_type", "cnt")
