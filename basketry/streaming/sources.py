"""Event streams from files, and from a message topic's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import schemas


def file_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the event files that arrive under ``path``."""
    return (
        spark.readStream.schema(schemas.EVENTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def _parsed(messages: DataFrame) -> DataFrame:
    text = F.col("value").cast("string")
    return messages.select(text.alias("text"), F.from_json(text, schemas.EVENTS).alias("e"))


def decode_messages(messages: DataFrame) -> DataFrame:
    """Events from records with a JSON ``value``, as a Kafka source delivers them.

    Records that are no events are left to ``undecoded_messages``.
    """
    return _parsed(messages).select("e.*").filter("tenant_id IS NOT NULL")


def undecoded_messages(messages: DataFrame) -> DataFrame:
    """(text) of the records that are no JSON events or name no tenant."""
    return _parsed(messages).filter("e.tenant_id IS NULL").select("text")
