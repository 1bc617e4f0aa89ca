"""Tenant scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_scope(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant; an unset or empty tenant sees nothing."""
    return df.filter(F.col("tenant_id") == F.nullif(F.lit(tenant_id).cast("string"), F.lit("")))
