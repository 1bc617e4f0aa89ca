"""Event files: Parquet partitioned by tenant and day, JSON bodies and TSV exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import schemas
from basketry.functions.expressions import moment

EVENT_PARTITIONS = ["tenant_id", "event_date"]


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("timestamp"))


def write_events(events: DataFrame, path: str) -> None:
    """Append events under ``tenant_id=/event_date=`` folders.

    The rebalance hint lets AQE split a busy tenant's day over several tasks and merge
    quiet ones, so files stay of even size whatever the skew.
    """
    (
        with_event_date(events)
        .hint("rebalance", *EVENT_PARTITIONS)
        .write.mode("append")
        .partitionBy(*EVENT_PARTITIONS)
        .parquet(path)
    )


def read_events(
    spark: SparkSession,
    path: str,
    tenant_id: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
) -> DataFrame:
    """Events of the lake in ``[since, until]``; dates and tenant prune whole folders."""
    layout = f"{schemas.EVENTS}, event_date DATE"
    df = spark.read.schema(layout).parquet(path)
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if since is not None:
        df = df.filter(
            (F.col("event_date") >= F.to_date(moment(since)))
            & (F.col("timestamp") >= moment(since))
        )
    if until is not None:
        df = df.filter(
            (F.col("event_date") <= F.to_date(moment(until)))
            & (F.col("timestamp") <= moment(until))
        )
    return df


def stored_ids(
    spark: SparkSession, path: str, since: datetime, until: datetime
) -> DataFrame:
    """(tenant_id, id) of the stored events of the days from ``since`` to ``until``."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hpath):
        return spark.createDataFrame([], "tenant_id STRING, id STRING")
    days = F.col("event_date").between(F.to_date(moment(since)), F.to_date(moment(until)))
    return read_events(spark, path).filter(days).select("tenant_id", "id")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies stored as JSON lines ``{batch_id, tenant_id, body}``."""
    return spark.read.schema(schemas.RAW_BATCHES).json(path)


def read_events_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated events: tenant, customer, type, product, properties, time.

    Quoted as CSV with doubled quotes; an empty field is NULL.
    """
    layout = (
        "tenant_id STRING, customer_id STRING, event_type STRING, product_id STRING,"
        " properties STRING, timestamp TIMESTAMP"
    )
    return (
        spark.read.schema(layout)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
