"""Request bodies ``{"events": [...]}`` to typed events; a bad body is rejected whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import stable_uuid
from basketry.schemas import MAX_BATCH_EVENTS

# Fixed value: the accepted written forms of a UUID, with or without hyphens.
UUID_PATTERN = (
    "(?i)^(urn:uuid:)?\\\\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\\\\}?$"
)
# Fixed value: numbers up to this size are seconds, larger ones milliseconds.
SECONDS_LIMIT = 20_000_000_000


def _kind(path: str) -> str:
    return f"schema_of_variant(try_variant_get(e, '{path}', 'variant'))"


def _text(path: str) -> str:
    return f"try_variant_get(e, '{path}', 'string')"


def _event_time() -> str:
    number = "try_variant_get(e, '$.timestamp', 'double')"
    seconds = f"if(abs({number}) <= {SECONDS_LIMIT}, {number}, {number} / 1000)"
    return (
        f"CASE WHEN {_kind('$.timestamp')} = 'STRING'"
        f" THEN try_cast({_text('$.timestamp')} AS timestamp)"
        f" WHEN {_kind('$.timestamp')} RLIKE '^(BIGINT|DOUBLE|DECIMAL)'"
        f" THEN timestamp_micros(cast(round({seconds} * 1000000) AS bigint)) END"
    )


def canonical_uuid(text: str) -> str:
    """SQL for the lower-case, hyphenated form of an accepted UUID in any written form."""
    digits = f"regexp_replace(lower({text}), '^urn:uuid:|[{{}}-]', '')"
    return f"regexp_replace({digits}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"


def _problem(uuid_ids: bool) -> str:
    """SQL text naming what is wrong with event ``e``, or NULL."""
    product = _kind("$.product_id")
    bad_product = f"{product} NOT IN ('VOID', 'STRING')"
    if uuid_ids:
        bad_product += (
            f" OR ({product} = 'STRING' AND NOT {_text('$.product_id')} RLIKE '{UUID_PATTERN}')"
        )
    return f"""CASE
        WHEN coalesce({_kind('$.customer_id')}, '') <> 'STRING' OR {_text('$.customer_id')} = ''
            THEN 'customer_id'
        WHEN coalesce({_kind('$.event_type')}, '') <> 'STRING' THEN 'event_type'
        WHEN {product} IS NOT NULL AND ({bad_product}) THEN 'product_id'
        WHEN {_kind('$.properties')} IS NOT NULL
            AND {_kind('$.properties')} NOT LIKE 'OBJECT%' THEN 'properties'
        WHEN {_event_time()} IS NULL THEN 'timestamp'
        END"""


def check_batches(raw: DataFrame, uuid_ids: bool = True) -> DataFrame:
    """``raw`` with its parsed ``events`` and the ``reason`` for a rejection, if any."""
    parsed = raw.withColumn("v", F.try_parse_json("body")).withColumn(
        "events", F.expr("try_variant_get(v, '$.events', 'array<variant>')")
    )
    problems = F.expr(f"filter(transform(events, e -> {_problem(uuid_ids)}), p -> p IS NOT NULL)")
    bad_tenant = F.coalesce(F.col("tenant_id") == "", F.lit(True))
    if uuid_ids:
        bad_tenant = bad_tenant | ~F.col("tenant_id").rlike(UUID_PATTERN.replace("\\\\", "\\"))
    reason = (
        F.when(bad_tenant, "tenant_id")
        .when(F.col("v").isNull(), "not json")
        .when(F.col("events").isNull(), "events missing")
        .when(F.size("events") > MAX_BATCH_EVENTS, "too many events")
        .when(F.size(problems) > 0, F.concat(F.lit("bad "), problems[0]))
    )
    return parsed.withColumn("reason", reason).drop("v")


def ingest_events(raw: DataFrame, uuid_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Events of the good bodies, and ``(batch_id, tenant_id, reason)`` of the others.

    Bodies of more than 1,000 events are rejected, as are bodies with a missing or
    mistyped field. Tenant and product ids are UUIDs in any written form and come out in
    the canonical one; ``uuid_ids=False`` admits other ids and leaves them as they are. An
    event's id is computed from its body's id, its place and its content, so a replay gives
    the same id.
    """
    checked = check_batches(raw, uuid_ids)
    rejected = checked.filter(F.col("reason").isNotNull()).select("batch_id", "tenant_id", "reason")
    rows = checked.filter(F.col("reason").isNull()).select(
        "batch_id", "tenant_id", F.posexplode("events").alias("place", "e")
    )
    tenant = canonical_uuid("tenant_id") if uuid_ids else "tenant_id"
    product = canonical_uuid(_text("$.product_id")) if uuid_ids else _text("$.product_id")
    rows = rows.withColumn("tenant_id", F.expr(tenant))
    accepted = rows.select(
        stable_uuid(
            F.col("tenant_id"), F.col("batch_id"), F.col("place"), F.to_json("e")
        ).alias("id"),
        "tenant_id",
        _sql(_text("$.customer_id"), "customer_id"),
        _sql(_text("$.event_type"), "event_type"),
        _sql(product, "product_id"),
        F.coalesce(
            F.to_json(F.expr("try_variant_get(e, '$.properties', 'variant')")), F.lit("{}")
        ).alias("properties"),
        _sql(_event_time(), "timestamp"),
    )
    return accepted, rejected


def _sql(text: str, name: str) -> Column:
    return F.expr(text).alias(name)


def deduplicate(events: DataFrame) -> DataFrame:
    """One row per tenant and event id; repeats of an event are equal."""
    return events.dropDuplicates(["tenant_id", "id"])
