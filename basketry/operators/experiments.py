"""A/B assignment and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import is_type, percent_bucket
from basketry.schemas import CUSTOMER


def assign_variant(customers: DataFrame, share_a: int = 50) -> DataFrame:
    """Adds ``bucket`` 0..99 from tenant and customer, and ``variant`` A below ``share_a``."""
    bucket = percent_bucket(F.col("tenant_id"), F.col("customer_id"))
    return customers.withColumn("bucket", bucket).withColumn(
        "variant", F.when(F.col("bucket") < share_a, "A").otherwise("B")
    )


def ab_results(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Exposures, buyers and later purchases per tenant and variant.

    ``decisions`` is the decision log. A purchase counts from the customer's first decision
    on. Decisions are folded to one row per customer, and purchases to one per customer and
    time, before they meet.
    """
    exposed = assign_variant(
        decisions.groupBy(*CUSTOMER).agg(
            F.count("*").alias("exposures"), F.min("created_at").alias("first_exposure")
        )
    )
    bought = (
        events.filter(is_type("purchase"))
        .groupBy(*CUSTOMER, "timestamp")
        .agg(F.count("*").alias("n"))
        .join(exposed.select(*CUSTOMER, "first_exposure"), CUSTOMER)
        .filter(F.col("timestamp") >= F.col("first_exposure"))
        .groupBy(*CUSTOMER)
        .agg(F.sum("n").alias("purchases"))
    )
    return (
        exposed.join(bought, CUSTOMER, "left")
        .groupBy("tenant_id", "variant")
        .agg(
            F.count("*").alias("customers"),
            F.sum("exposures").alias("exposures"),
            F.count("purchases").alias("buyers"),
            F.coalesce(F.sum("purchases"), F.lit(0)).alias("purchases"),
        )
        .withColumn("conversion", F.col("buyers") / F.col("customers"))
    )
