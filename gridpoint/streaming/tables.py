"""Markup read as it arrives: tables in files of JSON lines or Parquet to points, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.operators import grid as G
from gridpoint.operators import reader as R
from gridpoint.sources import markup

TABLE = "table_id long, raw string, caption string, footer string"


def arriving(spark: SparkSession, path: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """A stream of the tables in files put under path."""
    return spark.readStream.schema(TABLE).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def points(tables: DataFrame) -> DataFrame:
    """One row for each point of arriving tables."""
    text = markup.serialize(tables)
    return R.points(R.extract(text, G.parse(F.col("table_serialised"))))


def keep_reading(tables: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Starts writing the points of arriving tables as Parquet; with once, of those there now. Restarts go on from the checkpoint."""
    writer = points(tables).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
