"""Small tables for the hand-computed cases of FIXTURES.md."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from basketry import schemas

NOW = datetime(2026, 4, 20, 12, 0, tzinfo=timezone.utc)
DAY = timedelta(days=1)
HOUR = timedelta(hours=1)
MINUTE = timedelta(minutes=1)
MICRO = timedelta(microseconds=1)


def events(spark, rows):
    """Rows of (tenant, customer, type, product, time[, properties])."""
    full = [
        (f"e{i}", r[0], r[1], r[2], r[3], r[5] if len(r) > 5 else "{}", r[4])
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.EVENTS)


def products(spark, rows):
    """Rows of (id, tenant, category[, active])."""
    full = [
        (r[0], r[1], f"ext-{r[0]}", r[0], None, 9.5, "USD", r[2], [], "{}",
         r[3] if len(r) > 3 else True, NOW)
        for r in rows
    ]
    return spark.createDataFrame(full, schemas.PRODUCTS)


def features(spark, rows):
    """Rows of (tenant, customer, affinity map)."""
    base = spark.createDataFrame(
        rows, "tenant_id STRING, customer_id STRING, category_affinity MAP<STRING, DOUBLE>"
    )
    fields = [f.strip().split(" ", 1) for f in
              schemas.CUSTOMER_FEATURES.replace("MAP<STRING, DOUBLE>", "MAP<STRING;DOUBLE>")
              .replace("DECIMAL(12,2)", "DECIMAL(12;2)").split(",")]
    return base.select(*[
        F.col(n) if n in base.columns else F.lit(None).cast(t.replace(";", ",")).alias(n)
        for n, t in fields
    ])


def cooc(spark, rows):
    """Rows of (tenant, a, b, count, confidence)."""
    return spark.createDataFrame([(*r, NOW) for r in rows], schemas.COOCCURRENCE)


def requests(spark, rows):
    """Rows of (tenant, customer, limit, exclusions)."""
    full = [(f"r{i}", t, c, "home", n, x) for i, (t, c, n, x) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.REQUESTS)


def warm(spark, tenant="A", customer="cust"):
    """The warm customer: five products, three rules, a phone seen, carted and bought."""
    catalogue = [
        ("phone", tenant, "electronics"), ("earbuds", tenant, "electronics"),
        ("charger", tenant, "electronics"), ("case", tenant, "accessories"),
        ("shoes", tenant, "fashion"),
    ]
    history = [
        (tenant, customer, "product_view", "phone", NOW - 2 * DAY),
        (tenant, customer, "add_to_cart", "phone", NOW - DAY),
        (tenant, customer, "purchase", "phone", NOW - 12 * HOUR, '{"revenue": 499.0}'),
    ]
    rules = [
        (tenant, "phone", "earbuds", 5, 0.80), (tenant, "phone", "charger", 4, 0.60),
        (tenant, "phone", "case", 3, 0.40),
    ]
    scores = [(tenant, customer, {"electronics": 9.0, "accessories": 4.0})]
    return catalogue, history, rules, scores


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
