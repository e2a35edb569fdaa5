"""The observation log as an append stream: an extension, kept small. Late rows mean the views change, so nothing is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import funnel


def stream_observations(spark: SparkSession, folder: str, schema: str | StructType, per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def stream_funnel(obs: DataFrame) -> DataFrame:
    """The funnel of every entity, kept up to date (output mode: complete or update). State grows with entities, not with rows."""
    return funnel.entity_funnel(obs)
