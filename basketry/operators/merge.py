"""Upsert by natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def upsert_by_key(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` inserted, or replacing those of equal key."""
    kept = target.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*target.columns))
