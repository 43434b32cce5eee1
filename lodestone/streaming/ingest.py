"""Structured Streaming ingest: per-document stages run unchanged on a stream of files.

Extensions of the batch library: the corpus operators that need no other document work on a stream as they are,
cross-document ones stay batch and run per micro-batch or later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.corpus import paragraphs


def read_documents(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files as they arrive, so many per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def write_paragraphs(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Cleaned paragraphs of each arriving document, appended exactly once."""
    return paragraphs(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and kind, with a watermark for late rows."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
