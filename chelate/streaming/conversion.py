"""Streams of molecules: the encoding is one narrow stage without state, so a stream runs it as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chelate import schema
from chelate.constants import Config
from chelate.plans.encode import canonical_strings


def molecule_stream(spark: SparkSession, path: str) -> DataFrame:
    """Molecules from JSON lines in files that are added to a folder."""
    return spark.readStream.schema(schema.MOLECULE).json(path)


def convert_stream(molecules: DataFrame, path: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Append the converted records to ``path``; each file is converted once, also after a restart.

    Runs over what is there and ends. checkpoint: a folder that all executors share.
    """
    out = canonical_strings(molecules, config).writeStream.format("json").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def success_by_window(converted: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, total, n_valid for each window of event time; rows that are later than ``late`` are left out of closed windows."""
    rows = converted.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return rows.agg(F.count("*").alias("total"), F.count_if("valid").alias("n_valid")).select(F.col("w.start").alias("start"), "total", "n_valid")
