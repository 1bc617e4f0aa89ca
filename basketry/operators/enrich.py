"""Events joined with their product's category, and their revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import revenue


def attach_category(rows: DataFrame, products: DataFrame, spread: str | None = None) -> DataFrame:
    """Left join of ``category`` on equal tenant and product id.

    ``spread`` names a column that varies among rows without a product. It stands in as
    their join key, so they do not all hash to one task; a residual test keeps them from
    ever matching. A product met by very many rows is left to AQE's skew-join split.
    """
    catalogue = products.select(
        F.col("tenant_id").alias("p_tenant"), F.col("id").alias("p_id"), "category"
    )
    key = F.col("product_id") if spread is None else F.coalesce("product_id", spread)
    found = (F.col("tenant_id") == F.col("p_tenant")) & (key == F.col("p_id"))
    if spread is not None:
        found = found & F.col("product_id").isNotNull()
    return rows.join(catalogue, found, "left").drop("p_tenant", "p_id")


def enrich_events(events: DataFrame, products: DataFrame, on_bad: str = "fail") -> DataFrame:
    """Events with ``category`` (NULL for another tenant's product) and ``revenue``."""
    with_revenue = events.withColumn("revenue", revenue(F.col("properties"), on_bad))
    return attach_category(with_revenue, products, spread="id")
