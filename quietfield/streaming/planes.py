"""Planes that arrive as files, unrung as they come: the batch operator over a stream, without state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quietfield.operators.unring import unring

SCHEMA = "img string, z int, t int, px array<float>"


def unring_stream(spark: SparkSession, source: str, target: str, checkpoint: str, nx: int, ny: int, partial_fourier: float = 1.0, **trigger) -> StreamingQuery:
    """Read Parquet planes that appear in source, write them unrung to target; trigger as of DataStreamWriter."""
    planes = spark.readStream.schema(SCHEMA).parquet(source)
    out = unring(planes, nx, ny, partial_fourier)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
