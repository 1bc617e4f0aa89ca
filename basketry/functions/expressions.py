"""Column expressions: time arithmetic, event tests, revenue, weights, stable hashes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

REVENUE_TYPE = "decimal(38,18)"
MICROS_PER_DAY = 86_400_000_000


def moment(value: str | datetime | Column) -> Column:
    """A timestamp column; text and datetimes without a zone are read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value.astimezone(timezone.utc).isoformat()).cast("timestamp")


def before(as_of: str | datetime | Column, span: str) -> Column:
    """``as_of - span``, for example ``before(t, "30 days")``."""
    return moment(as_of) - F.expr(f"INTERVAL {span}")


def micros_of(span: str) -> int:
    """Microseconds in ``"<n> <unit>"`` with unit second, minute, hour or day."""
    amount, unit = span.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * seconds * 1_000_000


def time_slot(us: Column, width_us: int) -> Column:
    """Number of the fixed-width slot that holds ``us``, in exact integer arithmetic."""
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us))


def is_view() -> Column:
    return F.col("event_type").isin("page_view", "product_view")


def is_type(name: str) -> Column:
    return F.col("event_type") == name


def parsed_revenue(properties: Column, on_bad: str = "fail") -> Column:
    """Revenue from the JSON text, NULL when absent.

    ``on_bad="fail"`` raises on text that is no number, ``"null"`` gives NULL. JSON can
    spell the key only literally or with a ``\\u`` escape, so text with neither is not
    parsed at all.
    """
    text = F.when(
        properties.contains("revenue") | properties.contains("\\u"),
        F.get_json_object(properties, "$.revenue"),
    )
    if on_bad == "fail":
        return text.cast(REVENUE_TYPE)
    if on_bad == "null":
        return text.try_cast(REVENUE_TYPE)
    raise ValueError(f"on_bad must be 'fail' or 'null', not {on_bad!r}")


def revenue(properties: Column, on_bad: str = "fail") -> Column:
    """``parsed_revenue``, 0 when absent."""
    return F.coalesce(parsed_revenue(properties, on_bad), F.lit(0).cast(REVENUE_TYPE))


def affinity_weight(ts: Column, as_of: str | datetime | Column) -> Column:
    """3 within 7 days of ``as_of``, 1 within 30 days, else 0; the future counts as 3."""
    return (
        F.when(ts >= before(as_of, "7 days"), F.lit(3))
        .when(ts >= before(as_of, "30 days"), F.lit(1))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def stable_uuid(*parts: Column) -> Column:
    """An id in UUID form computed from ``parts``, equal on every retry."""
    tagged = [F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts]
    digest = F.sha2(F.to_json(F.array(*tagged)), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def percent_bucket(*parts: Column) -> Column:
    """A stable number 0..99 from the parts joined with ``:``."""
    head = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % 100).cast("int")
