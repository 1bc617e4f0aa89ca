"""Daily sketches that merge: distinct counts (HyperLogLog) and quantiles (KLL) of any range of days.

A sketch has a bounded size whatever it has seen, is built with map-side combining, and sketches of
days, categories or surfaces merge without the rows. So a report on a month reads thirty small rows
of a group. Results are estimates; the exact jobs are ``distinct_counts`` and ``latency_summary``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.enrich import attach_category

# Registers of a distinct sketch (2^12): a standard error of 1.04 / 64, 1.6 percent.
LOG_REGISTERS = 12
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
# Size of a quantile sketch: estimates lie within this share of the ranks, with a chance of 99 percent.
QUANTILE_SIZE, RANK_ERROR = 400, 0.011


def daily_distincts(events: DataFrame, products: DataFrame) -> DataFrame:
    """Sketches of the customers and products of each tenant, category and UTC day; and the events.

    Events are folded to one row per customer, product and day before they meet the products.
    """
    folded = events.groupBy("tenant_id", "customer_id", "product_id", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    named = attach_category(folded, products, "customer_id")
    return named.groupBy("tenant_id", "category", "day").agg(
        F.hll_sketch_agg("customer_id", F.lit(LOG_REGISTERS)).alias("customers"),
        F.hll_sketch_agg("product_id", F.lit(LOG_REGISTERS)).alias("products"),
        F.sum("n").alias("events"),
    )


def _within(day: str, first: str | date | None, last: str | date | None) -> Column:
    test = F.lit(True)
    if first is not None:
        test = test & (F.col(day) >= F.lit(str(first)).cast("date"))
    if last is not None:
        test = test & (F.col(day) <= F.lit(str(last)).cast("date"))
    return test


def distincts_between(
    sketches: DataFrame, first: str | date | None = None, last: str | date | None = None, by: list[str] | None = None
) -> DataFrame:
    """Estimated distinct customers and products, and events, from the daily sketches of a range.

    ``first`` and ``last`` are days, both included; ``by`` may leave out the category, whose sketches
    then merge: a customer of two categories counts once.
    """
    by = ["tenant_id", "category"] if by is None else by
    return sketches.filter(_within("day", first, last)).groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers"),
        F.hll_sketch_estimate(F.hll_union_agg("products")).alias("products"),
        F.sum("events").alias("events"),
    )


def daily_quantiles(log: DataFrame, by: list[str] | None = None, value: str = "latency_ms", at: str = "created_at") -> DataFrame:
    """A sketch of ``value`` for each group and UTC day; nulls are left out."""
    by = ["tenant_id", "surface"] if by is None else by
    seen = log.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return seen.groupBy(*by, F.to_date(at).alias("day")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("sketch")
    )


def quantiles_between(
    sketches: DataFrame,
    shares: list[float],
    first: str | date | None = None,
    last: str | date | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """(*by, share, value, requests): estimated quantiles from the daily sketches of a range."""
    by = ["tenant_id", "surface"] if by is None else by
    whole = sketches.filter(_within("day", first, last)).groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    asked = [F.struct(F.lit(p).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in shares]
    each = whole.select(*by, F.kll_sketch_get_n_double("sketch").alias("requests"), F.explode(F.array(*asked)).alias("q"))
    return each.select(*by, "q.share", "q.value", "requests")
