"""Streaming ingestion, de-duplication and windowed counts.

Each transformation takes a streaming or a batch DataFrame. The ``start_*`` functions run
a query on all data present and stop (``availableNow``), or continuously with a trigger
interval. State lives in RocksDB; offsets and sink progress in ``checkpoint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.operators.reports import day_measures, sliding_5m_features
from basketry.operators.sessions import session_windows
from basketry.schemas import CUSTOMER
from basketry.sources.lake import EVENT_PARTITIONS, with_event_date

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure_streaming(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Counting a store's rows costs a read before every write.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return spark


def deduplicate_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of each tenant and event id; repeats within ``delay`` are dropped."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["tenant_id", "id"]
    )


def stream_5m_features(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Per customer, counts in every five-minute window starting on a minute."""
    return sliding_5m_features(events.withWatermark("timestamp", delay))


def stream_daily_activity(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Views, purchases and cart adds per tenant and UTC day."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy("tenant_id", F.window("timestamp", "1 day").alias("w"))
        .agg(*day_measures())
        .select("tenant_id", F.to_date("w.start").alias("day"), "views", "purchases", "cart_adds")
    )


def stream_sessions(
    events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Sessions by inactivity gap; append mode emits one once the watermark passes its end."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(*CUSTOMER, F.session_window("timestamp", gap).alias("w"))
        .agg(
            F.min("timestamp").alias("session_start"),
            F.max("timestamp").alias("session_end"),
            F.count("*").alias("events"),
            F.count("product_id").alias("product_events"),
        )
        .drop("w")
    )


def sessions_left(events: DataFrame, emitted: DataFrame) -> DataFrame:
    """The sessions of ``events`` that the stream has not emitted as they are.

    A batch correction over the raw lake: sessions that were still open when the stream
    stopped, and those that rows behind the watermark belong to.
    """
    whole = session_windows(events)
    columns = [*CUSTOMER, "session_start", "session_end", "events", "product_events"]
    return whole.select(*columns).join(emitted.select(*columns), columns, "left_anti")


def _trigger(writer, interval: str | None):
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def start_append(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: list[str] | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append to Parquet; the sink's own log keeps each batch written exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, interval).start()


def is_complete() -> Column:
    """The rules of batch ingestion that concern a typed event: nothing required is missing."""
    named = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("id", "tenant_id", "customer_id")]
    return (
        named[0] & named[1] & named[2]
        & F.col("event_type").isNotNull() & F.col("timestamp").isNotNull()
    )


def start_ingest(
    events: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write the stream's complete events to the lake layout ``tenant_id=/event_date=``."""
    good = with_event_date(events.filter(is_complete()))
    return start_append(good, path, checkpoint, EVENT_PARTITIONS, interval)


def start_rejects(
    events: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write the events that ``start_ingest`` leaves out."""
    return start_append(events.filter(~is_complete()), path, checkpoint, None, interval)


def start_upserts(
    rows: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write each batch's changed rows under ``batch=<id>``; a retried batch replaces itself."""

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.outputMode("update").foreachBatch(save)
    return _trigger(writer.option("checkpointLocation", checkpoint), interval).start()


def latest_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key written by ``start_upserts``."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "row.*")
