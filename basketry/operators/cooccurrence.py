"""Directional product pairs: how many customers bought b within 30 days after a.

The pair test needs no single purchases. With time cut into slots as wide as the horizon,
a purchase of a in slot k can only reach purchases of b in slots k and k+1, and then

* in the same slot, some b follows some a when the last b is not before the first a;
* in the next slot, some b is near enough when the first b is within the horizon of the
  last a.

So purchases are first folded to first and last time per customer, product and slot.
This is exact, and a customer's repeated purchases cost nothing.

A customer who buys a very large range of products in one slot ("wide") would emit the
square of it. Such customers are kept apart; see ``pair_support``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import is_type, micros_of, moment, time_slot
from basketry.schemas import CUSTOMER, MIN_PAIR_SUPPORT, PAIR
from basketry.session import materialize

HORIZON = "30 days"
WIDE = 500
CHUNK = 2000


def purchase_slots(events: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """First and last purchase time per customer, product and slot."""
    us = F.unix_micros("timestamp")
    return (
        events.filter(is_type("purchase") & F.col("product_id").isNotNull())
        .groupBy(*CUSTOMER, "product_id", time_slot(us, micros_of(horizon)).alias("slot"))
        .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    )


def _buyers(slots: DataFrame) -> DataFrame:
    return (
        slots.select("tenant_id", "product_id", "customer_id")
        .distinct()
        .groupBy("tenant_id", "product_id")
        .agg(F.count("*").alias("customer_support"))
    )


def product_support(events: DataFrame) -> DataFrame:
    """Distinct buyers per product."""
    return _buyers(
        events.filter(is_type("purchase") & F.col("product_id").isNotNull())
    )


def _split_by_width(
    slots: DataFrame, wide: int, chunk: int
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of narrow customers, and rows of wide ones with the ``parts`` to cut them into.

    Whether there are wide customers at all is asked first, since there rarely are and the
    plan without them is far shorter. ``slots`` should be cheap to read more than once.
    """
    widths = (
        slots.groupBy(*CUSTOMER, "slot")
        .count()
        .filter(F.col("count") > wide)
        .groupBy(*CUSTOMER)
        .agg(F.max("count").alias("width"))
    )
    if widths.isEmpty():
        return slots, None
    parts = F.ceil(F.col("width") / chunk).cast("int").alias("parts")
    narrow_rows = slots.join(widths.select(*CUSTOMER), CUSTOMER, "left_anti")
    wide_rows = slots.join(widths.select(*CUSTOMER, parts), CUSTOMER)
    return narrow_rows, wide_rows


def _narrow_pairs(slots: DataFrame, horizon: str) -> DataFrame:
    """Distinct pairs of narrow customers, without a self-join.

    A slot of a narrow customer holds few products, so it fits an array. Each slot's array
    meets itself and the next slot's. All steps share one shuffle by customer.
    """
    item = F.struct("product_id", "first_us", "last_us")
    by_slot = Window.partitionBy(*CUSTOMER).orderBy("slot")
    arrays = (
        slots.repartition(*CUSTOMER)
        .groupBy(*CUSTOMER, "slot")
        .agg(F.collect_list(item).alias("here"))
        .withColumn("next_slot", F.lead("slot").over(by_slot))
        .withColumn("next_items", F.lead("here").over(by_slot))
    )
    none = F.expr("filter(here, x -> false)")
    later = F.when(F.col("next_slot") == F.col("slot") + 1, F.col("next_items")).otherwise(none)

    def tagged(items, is_next):
        return F.transform(
            items,
            lambda b: F.struct(
                b["product_id"].alias("product_id"),
                b["first_us"].alias("first_us"),
                b["last_us"].alias("last_us"),
                F.lit(is_next).alias("is_next"),
            ),
        )

    pairs = (
        arrays.select(*CUSTOMER, "here", F.concat(tagged(F.col("here"), False),
                                                  tagged(later, True)).alias("reach"))
        .select(*CUSTOMER, F.explode("here").alias("a"), "reach")
        .select(*CUSTOMER, "a", F.explode("reach").alias("b"))
    )
    near = F.when(
        F.col("b.is_next"), F.col("b.first_us") - F.col("a.last_us") <= micros_of(horizon)
    ).otherwise(F.col("b.last_us") >= F.col("a.first_us"))
    return (
        pairs.filter((F.col("a.product_id") != F.col("b.product_id")) & near)
        .select(
            *CUSTOMER,
            F.col("a.product_id").alias("product_a_id"),
            F.col("b.product_id").alias("product_b_id"),
        )
        .distinct()
    )


def _as_a(slots: DataFrame) -> DataFrame:
    """Rows in the role of a, once for each slot they can reach."""
    return slots.select(
        *[c for c in slots.columns if c not in ("product_id", "slot", "first_us", "last_us")],
        F.col("product_id").alias("product_a_id"),
        F.col("slot").alias("a_slot"),
        F.col("first_us").alias("a_first"),
        F.col("last_us").alias("a_last"),
        F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("b_slot"),
    )


def _as_b(slots: DataFrame) -> DataFrame:
    return slots.select(
        *CUSTOMER,
        F.col("product_id").alias("product_b_id"),
        F.col("slot").alias("b_slot"),
        F.col("first_us").alias("b_first"),
        F.col("last_us").alias("b_last"),
        *[c for c in slots.columns if c == "parts"],
    )


def _near(horizon: str):
    return (
        F.when(F.col("b_slot") == F.col("a_slot"), F.col("b_last") >= F.col("a_first"))
        .otherwise(F.col("b_first") - F.col("a_last") <= micros_of(horizon))
    ) & (F.col("product_a_id") != F.col("product_b_id"))


def _bit(product: str):
    """One of 64 bits, for a product."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(product), F.lit(64)).cast("int"))


def _wide_pairs(slots: DataFrame, horizon: str) -> DataFrame:
    """Distinct pairs of wide customers, cut into ``parts`` by product a.

    Each part of a meets all b of the customer, so the work of one customer is spread
    over ``parts`` tasks and b is copied ``parts`` times.
    """
    a = _as_a(slots).withColumn(
        "part", F.pmod(F.xxhash64("product_a_id"), F.col("parts").cast("bigint")).cast("int")
    ).drop("parts")
    b = _as_b(slots).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).drop("parts")
    return (
        a.join(b, [*CUSTOMER, "b_slot", "part"])
        .filter(_near(horizon))
        .select(*CUSTOMER, "product_a_id", "product_b_id")
        .distinct()
    )


def candidate_pairs(
    events: DataFrame, horizon: str = HORIZON, wide: int = WIDE, chunk: int = CHUNK
) -> DataFrame:
    """Distinct ordered pairs per customer, b bought within ``horizon`` after a."""
    slots = materialize(purchase_slots(events, horizon), "purchase-slots")
    narrow, wide_rows = _split_by_width(slots, wide, chunk)
    pairs = _narrow_pairs(narrow, horizon)
    return pairs if wide_rows is None else pairs.unionByName(_wide_pairs(wide_rows, horizon))


def pair_counts(pairs: DataFrame, min_support: int = MIN_PAIR_SUPPORT) -> DataFrame:
    """Customers per pair, for pairs of at least ``min_support`` customers."""
    return (
        pairs.groupBy(*PAIR)
        .agg(F.count("*").alias("co_count"))
        .filter(F.col("co_count") >= min_support)
    )


def pair_support(
    slots: DataFrame,
    min_support: int = MIN_PAIR_SUPPORT,
    horizon: str = HORIZON,
    wide: int = WIDE,
    chunk: int = CHUNK,
) -> DataFrame:
    """``pair_counts`` of all customers without listing the pairs of wide ones.

    Pairs of narrow customers are listed and counted. A wide customer is only asked about
    those pairs, by looking up both products. Pairs that no narrow customer has need
    ``min_support`` wide customers, so they are listed for products with that many wide
    buyers only; one or two wide customers list nothing. A row that asks for a product b travels
    only if the customer's slot has the bit of one like it, which tells most of the others.
    """
    narrow, wide_rows = _split_by_width(slots, wide, chunk)
    listed = _narrow_pairs(narrow, horizon).groupBy(*PAIR).agg(F.count("*").alias("narrow_n"))
    if wide_rows is None:
        return listed.withColumnRenamed("narrow_n", "co_count").filter(
            F.col("co_count") >= min_support
        )

    listed = materialize(listed, "narrow-pairs")
    wide_rows = materialize(wide_rows, "wide-slots")
    held = wide_rows.groupBy(*CUSTOMER, F.col("slot").alias("b_slot")).agg(F.bit_or(_bit("product_id")).alias("held"))
    holders = _as_a(wide_rows.drop("parts")).join(held, [*CUSTOMER, "b_slot"])
    asked = (
        listed.select(*PAIR, _bit("product_b_id").alias("bit"))
        .join(holders, ["tenant_id", "product_a_id"])
        .filter(F.col("held").bitwiseAND(F.col("bit")) != 0)
        .drop("held", "bit")
        .join(_as_b(wide_rows.drop("parts")), [*CUSTOMER, "b_slot", "product_b_id"])
        .filter(_near(horizon))
        .select(*PAIR, "customer_id")
        .distinct()
        .groupBy(*PAIR)
        .agg(F.count("*").alias("wide_n"))
    )
    counted = listed.join(asked, PAIR, "left").select(
        *PAIR, (F.col("narrow_n") + F.coalesce("wide_n", F.lit(0))).alias("co_count")
    )

    common = _buyers(wide_rows).filter(F.col("customer_support") >= min_support)
    wide_only = (
        _wide_pairs(
            wide_rows.join(common, ["tenant_id", "product_id"], "left_semi"), horizon
        )
        .groupBy(*PAIR)
        .agg(F.count("*").alias("co_count"))
        .filter(F.col("co_count") >= min_support)
        .join(listed, PAIR, "left_anti")
    )
    return counted.filter(F.col("co_count") >= min_support).unionByName(wide_only)


def cooccurrence(
    events: DataFrame,
    computed_at: str | datetime,
    min_support: int = MIN_PAIR_SUPPORT,
    horizon: str = HORIZON,
    wide: int = WIDE,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rules a -> b with ``co_count`` and ``confidence = co_count / buyers of a``.

    A pair cannot have more customers than its rarer product, so products with fewer than
    ``min_support`` buyers are dropped before pairs are formed.
    """
    slots = materialize(purchase_slots(events, horizon), "purchase-slots")
    support = _buyers(slots).filter(F.col("customer_support") >= min_support)
    frequent = slots.join(support, ["tenant_id", "product_id"], "left_semi")
    counts = pair_support(frequent, min_support, horizon, wide, chunk)
    return counts.join(
        support.withColumnRenamed("product_id", "product_a_id"), ["tenant_id", "product_a_id"]
    ).select(
        *PAIR,
        F.col("co_count").cast("int").alias("co_count"),
        F.when(F.col("customer_support") == 0, F.lit(0.0))
        .otherwise(F.col("co_count").cast("double") / F.col("customer_support").cast("double"))
        .alias("confidence"),
        moment(computed_at).alias("last_updated"),
    )


def related_products(cooc: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best products b for every product a."""
    best_first = Window.partitionBy("tenant_id", "product_a_id").orderBy(
        F.desc("confidence"), F.desc("co_count"), "product_b_id"
    )
    return (
        cooc.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= n)
        .select("tenant_id", "product_a_id", F.col("product_b_id").alias("product_id"),
                "co_count", "confidence", "rank")
    )


def related_for_anchors(anchors: DataFrame, cooc: DataFrame, k: int | None = None) -> DataFrame:
    """Related products of every anchor row, all of them or the best ``k``.

    ``anchors`` has ``tenant_id``, ``product_id`` and any further columns, which are kept.
    """
    if k is None:
        rules = cooc.select("tenant_id", F.col("product_a_id").alias("anchor_product_id"),
                            "product_b_id", "confidence", "co_count")
    else:
        rules = related_products(cooc, k).select(
            "tenant_id", F.col("product_a_id").alias("anchor_product_id"),
            F.col("product_id").alias("product_b_id"), "confidence", "co_count"
        )
    return (
        anchors.withColumnRenamed("product_id", "anchor_product_id")
        .join(rules, ["tenant_id", "anchor_product_id"])
        .withColumnRenamed("product_b_id", "product_id")
    )
