"""The decision log and reports on it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import moment, stable_uuid
from basketry.operators.requests import REQUEST
from basketry.schemas import MODEL_VERSION
from basketry.sources.tables import append_new

RANKED_ITEM = "struct<rank:int,product_id:string,score:double,reason:string>"
WIDE = "decimal(38,12)"
PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def log_decisions(
    recs: DataFrame,
    requests: DataFrame,
    as_of: str | datetime,
    latency_ms: Column | None = None,
    model_version: str = MODEL_VERSION,
) -> DataFrame:
    """One row per request with its items in rank order; an empty answer is logged too.

    The decision id is computed from the request, so a repeated run writes the same ids.
    """
    item = F.struct("rank", "product_id", "score", "reason")
    lists = recs.groupBy(*REQUEST).agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    items = F.transform(
        F.coalesce("ranked", F.array().cast(f"array<{RANKED_ITEM}>")),
        lambda r: F.struct(r["product_id"].alias("product_id"), r["score"].alias("score"),
                           r["reason"].alias("reason")),
    )
    latency = F.lit(None) if latency_ms is None else latency_ms
    return requests.join(lists, REQUEST, "left").select(
        "tenant_id",
        "customer_id",
        "surface",
        stable_uuid(
            F.col("tenant_id"), F.col("request_id"), F.lit(model_version), moment(as_of)
        ).alias("decision_id"),
        F.lit(model_version).alias("model_version"),
        items.alias("response_items"),
        F.round(latency.cast("double"), 2).alias("latency_ms"),
        moment(as_of).alias("created_at"),
    )


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Add to the log, under ``tenant_id=/log_date=`` folders, the decisions it lacks."""
    dated = decisions.withColumn("log_date", F.to_date("created_at"))
    append_new(dated, path, ["tenant_id", "log_date", "decision_id"], ["tenant_id", "log_date"])


def latency_summary(
    log: DataFrame, by: list[str] | None = None, value: str = "latency_ms"
) -> DataFrame:
    """Count, extremes, mean and rank-based percentiles of ``value`` per group.

    Percentile p is the value at zero-based place ``min(int(n * p), n - 1)``. It is found
    exactly without sorting a group in one task: equal values are counted, counts are
    added up over coarse logarithmic buckets, and only values within one bucket are put
    in order. The mean adds up decimals of twelve places, so it does not depend on order;
    groups with values too large for that (from 10^26) are added up as doubles.
    """
    by = ["tenant_id", "surface"] if by is None else by
    v = F.col(value)
    counts = (
        log.filter(v.isNotNull())
        .groupBy(*by, v.alias("v"))
        .agg(
            F.count("*").alias("n"),
            F.try_sum(v.try_cast(WIDE)).alias("exact"),
            F.count(v.try_cast(WIDE)).alias("fitting"),
        )
        .withColumn("bucket", F.floor(F.signum("v") * F.log2(F.abs("v") + 1) * 64))
    )
    up_to_bucket = (
        Window.partitionBy(*by).orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy(*by)
    buckets = (
        counts.groupBy(*by, "bucket")
        .agg(
            F.sum("n").alias("bucket_n"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            F.when(F.sum("fitting") == F.sum("n"), F.try_sum("exact")).alias("exact"),
            F.sum(F.col("v").cast("double") * F.col("n")).alias("about"),
        )
        .withColumn("ahead", F.sum("bucket_n").over(up_to_bucket) - F.col("bucket_n"))
        .withColumn("requests", F.sum("bucket_n").over(whole))
    )
    summary = buckets.groupBy(*by).agg(
        F.sum("bucket_n").alias("requests"),
        F.min("low").alias("fastest"),
        F.max("high").alias("slowest"),
        (
            F.coalesce(
                F.when(F.count("exact") == F.count("*"), F.try_sum("exact")).cast("double"),
                F.sum("about"),
            )
            / F.sum("bucket_n")
        ).alias("average"),
    )
    in_bucket = (
        Window.partitionBy(*by, "bucket").orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.col("requests") - 1
    place = {
        name: F.least(F.floor(F.col("requests") * F.lit(p)).cast("bigint"), last)
        for name, p in PERCENTILES.items()
    }
    end = F.col("ahead") + F.col("upto")
    located = (
        counts.withColumn("upto", F.sum("n").over(in_bucket))
        .join(buckets.select(*by, "bucket", "ahead", "requests"), [*by, "bucket"])
        .groupBy(*by)
        .agg(
            *[
                F.max(F.when((at >= end - F.col("n")) & (at < end), F.col("v"))).alias(name)
                for name, at in place.items()
            ]
        )
    )
    return summary.join(located, by)


def fallback_report(recs: DataFrame) -> DataFrame:
    """Items and requests per tenant, surface and reason."""
    per_request = recs.groupBy(*REQUEST, "surface", "reason").agg(F.count("*").alias("items"))
    return per_request.groupBy("tenant_id", "surface", "reason").agg(
        F.sum("items").alias("items"), F.count("*").alias("requests")
    )
