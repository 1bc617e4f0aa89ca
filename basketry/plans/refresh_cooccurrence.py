"""Recompute the pairs of all given tenants and replace their stored rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from basketry.operators.cooccurrence import cooccurrence
from basketry.schemas import COOCCURRENCE
from basketry.sources.tables import replace_tenants

# The order in which rules are looked up: an anchor's best first.
LOOKUP_ORDER = ["product_a_id", "confidence", "co_count"]


def refresh_cooccurrence(
    events: DataFrame, tenants: DataFrame, path: str, computed_at: str | datetime
) -> DataFrame:
    """Replace the pairs of every tenant in ``tenants``; returns those left without pairs.

    A tenant without events loses its stored pairs; events of other tenants are not looked at.
    """
    named = tenants.select("tenant_id").distinct()
    pairs = cooccurrence(events.join(named, "tenant_id", "left_semi"), computed_at)
    return replace_tenants(pairs, path, named, COOCCURRENCE, LOOKUP_ORDER)
