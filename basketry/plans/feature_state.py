"""Customer features from stored partial aggregates, to which batches of events are added once.

The state holds, per customer, what the features need of a session slot and of a day's events with
a product. All of it merges by sums, minima and maxima, so events may come in any order, late ones
too, and no event is read twice: a batch is folded, appended to the state, and the features of its
customers are made from the state alone.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import features as f
from basketry.plans.customer_features import finished_features, folded_slots
from basketry.schemas import AFFINITY_TYPES, CUSTOMER, CUSTOMER_FEATURES
from basketry.session import materialize
from basketry.sources import cells, tables

STATE = (
    "tenant_id STRING, customer_id STRING, slot BIGINT, day INT, product_id STRING,"
    " start_us BIGINT, end_us BIGINT, product_events BIGINT, total_views BIGINT, total_cart_adds BIGINT,"
    " total_purchases BIGINT, first_buy_us BIGINT, last_buy_us BIGINT, revenue DECIMAL(38,18),"
    " paid_total DECIMAL(38,18), paid_n BIGINT, affinity_events BIGINT"
)
# A state row is of a slot, or of a day and a product.
KEYS = [*CUSTOMER, "slot", "day", "product_id"]
LEAST, MOST = ["start_us", "first_buy_us"], ["end_us", "last_buy_us"]
SUMS = [
    "product_events", "total_views", "total_cart_adds", "total_purchases", "revenue", "paid_total", "paid_n", "affinity_events",
]
BY = ["tenant_id"]


def folded(events: DataFrame, on_bad: str = "fail") -> DataFrame:
    """State rows of a set of events."""
    day = F.unix_date(F.to_date("timestamp"))
    touches = events.filter(F.col("product_id").isNotNull()).groupBy(*CUSTOMER, day.alias("day"), "product_id").agg(
        F.count_if(F.col("event_type").isin(*AFFINITY_TYPES)).alias("affinity_events")
    )
    both = folded_slots(events, on_bad).unionByName(touches, allowMissingColumns=True)
    return both.select(*[name.split()[0] for name in STATE.replace("(38,18)", "").split(", ")])


def merged(state: DataFrame) -> DataFrame:
    """State rows of equal keys as one."""
    measures: list[Column] = [F.min(c).alias(c) for c in LEAST] + [F.max(c).alias(c) for c in MOST] + [F.sum(c).alias(c) for c in SUMS]
    return state.groupBy(*KEYS).agg(*measures)


def features_of(state: DataFrame, products: DataFrame, as_of: str | datetime) -> DataFrame:
    """The feature rows of all customers in ``state``, as ``customer_features`` gives them.

    Affinity is kept by day, so ``as_of`` must be a midnight (UTC).
    """
    at = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    at = at.astimezone(timezone.utc) if at.tzinfo else at
    if (at.hour, at.minute, at.second, at.microsecond) != (0, 0, 0, 0):
        raise ValueError("affinity is kept by day: as_of must be a midnight")

    def since(days: int) -> Column:
        return F.col("day") >= F.unix_date(F.lit((at - timedelta(days=days)).date()))

    whole = merged(state)
    weight = F.when(since(7), 3).when(since(30), 1).otherwise(0).cast("bigint")
    touches = whole.filter(F.col("product_id").isNotNull()).groupBy(*CUSTOMER, "product_id").agg(
        F.sum(weight * F.col("affinity_events")).alias("weight"), F.sum("affinity_events").alias("affinity_events")
    )
    slots = whole.filter(F.col("slot").isNotNull()).drop("day", "product_id", "affinity_events")
    return finished_features(slots, touches, products, as_of)


def add_events(
    events: DataFrame,
    products: DataFrame,
    state_root: str,
    features_root: str,
    as_of: str | datetime,
    batch: str,
    on_bad: str = "fail",
) -> DataFrame:
    """Add a batch of new events to the state and refresh the features of its customers; returns these.

    ``batch`` names the events: a batch that was added before changes the state no more, only the
    features are made again, so a run that broke off is simply repeated. ``updated_at`` is the time
    of the tenant's last event in the batch. Old events are not read; of the state, only the cells
    that hold customers of the batch. Of an empty batch only the name is stored.
    """
    spark = events.sparkSession
    fresh = materialize(folded(events, on_bad), "batch")
    cells.append(fresh, state_root, CUSTOMER, STATE, BY, note=batch)
    bounds = fresh.groupBy("tenant_id").agg(F.timestamp_micros(F.max("end_us")).alias("max_ts"))
    held = cells.lookup(fresh.select(*CUSTOMER), state_root, CUSTOMER, STATE, BY)
    made = features_of(held, products, as_of).drop("updated_at")
    layout = [field.name for field in spark.createDataFrame([], CUSTOMER_FEATURES).schema]
    updates = materialize(made.join(bounds.withColumnRenamed("max_ts", "updated_at"), "tenant_id").select(*layout), "updates")
    tables.upsert_table(updates, features_root, CUSTOMER, CUSTOMER_FEATURES, BY)
    return updates


def compact_state(spark: SparkSession, state_root: str, most: int = 4) -> int | None:
    """Merge the rows of cells to which more than ``most`` files were added."""
    return cells.compact(spark, state_root, CUSTOMER, STATE, merged, BY, most)
