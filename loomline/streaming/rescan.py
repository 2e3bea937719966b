"""Line statistics kept up to date over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.catalogue import Catalogue
from ..operators.stats import language_stats, text_stats


def arriving(spark: SparkSession, folder: str, schema: str = "name string, text string") -> DataFrame:
    """Parquet files of (name, text) as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def running_stats(stream: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """Per-language sums of everything that has arrived; state is one row for each language. For complete or update mode."""
    return language_stats(text_stats(stream, catalogue=catalogue))
