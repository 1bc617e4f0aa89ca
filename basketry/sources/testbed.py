"""Binds the generated test tables to the library's tables (see FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import configure

AS_OF = "2024-02-05 00:00:00"
LAST_DAY = "2024-01-31 00:00:00"


def _tenant(key: Column) -> Column:
    return F.concat(F.lit("t"), (key % 3).cast("string"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Map the generated ``events`` columns, batch or streaming, to interaction events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    t = F.col("event_id") % 3
    kind = F.col("event_type")
    event_type = (
        F.when(kind == "view", "product_view")
        .when(kind == "signup", "page_view")
        .when(kind == "error", "dismiss")
        .when(kind == "purchase", "purchase")
        .when(k % 2 == 0, "click")
        .otherwise("add_to_cart")
    )
    slot = k % 40
    product = F.when(
        ~kind.isin("signup", "error"),
        F.when(slot == 39, slot * 3 + (t + 1) % 3).otherwise(slot * 3 + t).cast("string"),
    )
    properties = F.when(
        (kind == "purchase") & (k % 10 != 0),
        F.concat(F.lit('{"revenue": '), F.col("value").cast("string"), F.lit("}")),
    ).otherwise("{}")
    return raw.select(
        F.col("event_id").cast("string").alias("id"),
        _tenant(F.col("event_id")).alias("tenant_id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("customer_id"),
        event_type.alias("event_type"),
        product.alias("product_id"),
        properties.alias("properties"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(configure(spark).read.parquet(f"{sf_dir}/events.parquet"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = configure(spark).read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        _tenant(F.col("p_partkey")).alias("tenant_id"),
        F.concat(F.lit("ext-"), F.col("p_partkey").cast("string")).alias("external_id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
        (F.col("p_size") % 5 != 0).alias("active"),
    )


def requests(spark: SparkSession, sf_dir: str, limit: int = 8, exclude: bool = False) -> DataFrame:
    """One request per customer and one for an unknown customer per tenant.

    ``exclude`` asks each request to leave out its tenant's products numbered below 30.
    """
    people = events(spark, sf_dir).select("tenant_id", "customer_id").distinct()
    cold = people.select("tenant_id", F.lit("cold").alias("customer_id")).distinct()
    number = F.substring("tenant_id", 2, 10).cast("int")
    low_ids = F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: (i * 3 + number).cast("string")
    )
    return people.unionByName(cold).select(
        F.concat_ws("/", "tenant_id", "customer_id").alias("request_id"),
        "tenant_id",
        "customer_id",
        F.lit("home").alias("surface"),
        F.lit(limit).alias("limit"),
        (low_ids if exclude else F.array().cast("array<string>")).alias("exclude_product_ids"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies holding the events: fixed runs of 2,400 ids, split by tenant.

    Of every three runs, the last two travel as one body of up to 1,600 events, and the
    event with every 5,000th id has no customer, so both rejection rules are met. A body
    has a fixed greatest size.
    """
    run = F.floor(F.col("id").cast("bigint") / 2400)
    body_no = F.when(run % 3 == 2, run - 1).otherwise(run)
    customer = F.when(F.col("id").cast("bigint") % 5000 == 4999, "").otherwise(F.col("customer_id"))
    record = F.struct(
        customer.alias("customer_id"),
        "event_type",
        "product_id",
        F.from_json("properties", "revenue DOUBLE").alias("properties"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    numbered = F.struct(F.col("id").cast("bigint"), record.alias("record"))
    return (
        events(spark, sf_dir)
        .groupBy("tenant_id", body_no.alias("body_no"))
        .agg(F.array_sort(F.collect_list(numbered)).alias("es"))
        .select(
            F.concat_ws("-", "tenant_id", F.col("body_no").cast("string")).alias("batch_id"),
            "tenant_id",
            F.to_json(
                F.struct(F.transform("es", lambda e: e["record"]).alias("events"))
            ).alias("body"),
        )
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated event file as a stream."""
    columns = (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,"
        " value DOUBLE, props STRING"
    )
    raw = (
        configure(spark).readStream.schema(columns)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return shape_events(raw)


def latency_log(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """A log with the event kind as surface and the event value as latency."""
    raw = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        _tenant(F.col("event_id")).alias("tenant_id"),
        F.col("event_type").alias("surface"),
        F.col("value").alias("latency_ms"),
        *([F.col("ts").cast("timestamp").alias("created_at")] if with_time else []),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region, standing in as tenants ``t0`` to ``t4``."""
    region = configure(spark).read.parquet(f"{sf_dir}/region.parquet")
    key = F.concat(F.lit("t"), F.col("r_regionkey").cast("string"))
    return region.select(
        key.alias("id"),
        F.col("r_name").alias("name"),
        F.lower("r_name").alias("slug"),
        F.lit("pro").alias("plan_tier"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"),
    )
