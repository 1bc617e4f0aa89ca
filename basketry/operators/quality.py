"""Counts of rows that break a table's rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.schemas import CUSTOMER, EVENT_TYPES, PAIR, USER_ROLES

# Keys, required columns, length limits and value sets of each table.
UNIQUE = {
    "tenant": [["id"], ["slug"]],
    "user": [["id"], ["email"]],
    "product": [["id"]],
    "interactionevent": [["id", "timestamp"]],
    "customer_features": [CUSTOMER],
    "pipeline_checkpoints": [["tenant_id", "pipeline_name"]],
    "product_cooccurrence": [PAIR],
    "recommendation_decisions": [["decision_id"]],
}
REQUIRED = {
    "tenant": ["id", "name", "slug", "plan_tier", "created_at"],
    "user": ["id", "tenant_id", "email", "password_hash", "display_name", "role"],
    "product": ["id", "tenant_id", "external_id", "title", "price", "category", "active"],
    "interactionevent": ["tenant_id", "customer_id", "event_type", "timestamp"],
    "customer_features": ["tenant_id", "customer_id", "category_affinity", "total_revenue"],
    "pipeline_checkpoints": ["tenant_id", "pipeline_name"],
    "product_cooccurrence": [*PAIR, "co_count", "confidence"],
    "recommendation_decisions": ["tenant_id", "customer_id", "surface", "decision_id"],
}
MAX_LENGTH = {
    "pipeline_checkpoints": {"pipeline_name": 100},
    "recommendation_decisions": {"surface": 100, "decision_id": 100, "model_version": 100},
}
DOMAINS = {
    "interactionevent": {"event_type": list(EVENT_TYPES)},
    "user": {"role": list(USER_ROLES)},
}
FOREIGN = [
    ("product", ["tenant_id"], "tenant", ["id"]),
    ("user", ["tenant_id"], "tenant", ["id"]),
    ("interactionevent", ["product_id", "tenant_id"], "product", ["id", "tenant_id"]),
]


def _row_checks(name: str, columns: list[str]) -> dict[str, Column]:
    checks = {
        f"not_null:{c}": F.col(c).isNull() for c in REQUIRED.get(name, []) if c in columns
    }
    for c, size in MAX_LENGTH.get(name, {}).items():
        if c in columns:
            checks[f"length:{c}"] = F.length(c) > size
    for c, values in DOMAINS.get(name, {}).items():
        if c in columns:
            checks[f"domain:{c}"] = ~F.col(c).isin(*values)
    if name == "product_cooccurrence":
        checks["range:co_count"] = F.col("co_count") < 3
        checks["range:confidence"] = (F.col("confidence") <= 0) | (F.col("confidence") > 1)
    return checks


def _named(name: str, check: str, counted: DataFrame) -> DataFrame:
    return counted.select(
        F.lit(name).alias("table_name"), F.lit(check).alias("check_name"), "violations"
    )


def integrity_report(
    tables: dict[str, DataFrame], partitions: list[tuple[str, str]] | None = None
) -> DataFrame:
    """``table_name, check_name, violations`` for every rule of the given tables.

    Row rules of a table are counted in one scan. ``unique`` counts keys held by more than
    one row. ``foreign`` counts rows whose reference is set but missing. ``partitions``
    lists the half-open time ranges events may fall in.
    """
    parts = []
    for name, df in tables.items():
        checks = _row_checks(name, df.columns)
        if name == "interactionevent" and partitions is not None:
            inside = [
                (F.col("timestamp") >= F.lit(lo).cast("timestamp"))
                & (F.col("timestamp") < F.lit(hi).cast("timestamp"))
                for lo, hi in partitions
            ]
            checks["partition:timestamp"] = ~reduce(lambda x, y: x | y, inside, F.lit(False))
        if checks:
            counts = df.agg(*[F.count_if(test).alias(check) for check, test in checks.items()])
            pairs = F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("check_name"), F.col(f"`{c}`").alias("violations"))
                        for c in checks
                    ]
                )
            ).alias("r")
            parts.append(counts.select(pairs).select(F.lit(name).alias("table_name"), "r.*"))
        for key in UNIQUE.get(name, []):
            if set(key) <= set(df.columns):
                repeated = df.groupBy(*key).count().filter(F.col("count") > 1)
                parts.append(
                    _named(name, f"unique:{','.join(key)}",
                           repeated.agg(F.count("*").alias("violations")))
                )
    for child, columns, parent, keys in FOREIGN:
        if child in tables and parent in tables:
            # Folded to one row per reference first: a busy product is one row to look up.
            refs = (
                tables[child].filter(F.col(columns[0]).isNotNull())
                .groupBy(*columns).agg(F.count("*").alias("n"))
            )
            known = tables[parent].select(*[F.col(k).alias(c) for k, c in zip(keys, columns)])
            missing = refs.join(known, columns, "left_anti")
            parts.append(
                _named(child, f"foreign:{','.join(columns)}",
                       missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
            )
    return reduce(DataFrame.unionByName, parts)
