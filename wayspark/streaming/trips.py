"""Structured Streaming over raw trips.

Cleaning and encoding look at one row at a time, so the batch operators serve streams as
they are. Counts by event time hold state for open windows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayspark.config import DEFAULT, Params
from wayspark.operators import clean, encode
from wayspark.sources.io import RAW_SCHEMA


def raw_stream(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files below path, as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def encoded_stream(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return encode.encode(clean.clean(raw, p), p)


def busy_cells(encoded: DataFrame, res: int = 9, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, cell, visits) by the trips' start; rows later than `late` are dropped."""
    at = encoded.withColumn("at", F.timestamp_seconds("TIMESTAMP")).withWatermark("at", late)
    return at.select("at", F.explode(f"cells_res{res}").alias("cell")).groupBy(F.window("at", window).alias("window"), "cell").agg(F.count("*").alias("visits"))


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Append to Parquet, exactly once through the checkpoint."""
    w = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start(path)
