import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import cooccurrence as co
from basketry.schemas import PAIR
from tests.builders import DAY, HOUR, MICRO, NOW, cooc, events, rows

BUY = "purchase"


def brute(history):
    """Distinct (tenant, customer, a, b) by comparing every two purchases."""
    found = set()
    for t, c, _, p, at in history:
        for t2, c2, _, p2, at2 in history:
            if (t, c) == (t2, c2) and p != p2 and at <= at2 <= at + 30 * DAY:
                found.add((t, c, p, p2))
    return sorted(found)


def random_history(seed, customers=8, items=9, n=150):
    pick = random.Random(seed)
    return [
        (pick.choice("AB"), f"c{pick.randrange(customers)}", BUY, f"p{pick.randrange(items)}",
         NOW - pick.randrange(0, 200) * DAY - pick.randrange(2) * HOUR)
        for _ in range(n)
    ]


def test_one_way_pair(spark):
    history = []
    for c in ("x", "y", "z"):
        history += [("A", c, BUY, "phone", NOW - 10 * DAY), ("A", c, BUY, "earbuds", NOW - 5 * DAY)]
    got = co.cooccurrence(events(spark, history), NOW)
    assert rows(got, *PAIR, "co_count", "confidence") == [("A", "phone", "earbuds", 3, 1.0)]


def test_minimum_support(spark):
    history = []
    for c in ("x", "y"):
        history += [("A", c, BUY, "p", NOW - DAY), ("A", c, BUY, "q", NOW)]
    assert co.cooccurrence(events(spark, history), NOW).count() == 0


def test_horizon_is_inclusive(spark):
    history = [("A", "in", BUY, "a", NOW), ("A", "in", BUY, "b", NOW + 30 * DAY),
               ("A", "out", BUY, "a", NOW), ("A", "out", BUY, "b", NOW + 30 * DAY + MICRO)]
    got = co.candidate_pairs(events(spark, history))
    assert rows(got, "customer_id", *PAIR) == [("in", "A", "a", "b")]


def test_simultaneous_purchases_pair_both_ways(spark):
    history = [("A", "c", BUY, "a", NOW), ("A", "c", BUY, "b", NOW)]
    got = co.candidate_pairs(events(spark, history))
    assert rows(got, "product_a_id", "product_b_id") == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("wide,chunk", [(500, 2000), (3, 2), (1, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed, wide, chunk):
    history = random_history(seed)
    got = co.candidate_pairs(events(spark, history), wide=wide, chunk=chunk)
    assert rows(got, "tenant_id", "customer_id", "product_a_id", "product_b_id") == brute(history)


@pytest.mark.parametrize("wide,chunk", [(500, 2000), (3, 2), (2, 1), (0, 1)])
@pytest.mark.parametrize("seed", [3, 4])
def test_counts_equal_brute_force(spark, seed, wide, chunk):
    """Narrow only, mixed and wide only: the asked and the listed counts add up."""
    history = random_history(seed, customers=10, items=7, n=200)
    expected = {}
    for t, _, a, b in brute(history):
        expected[t, a, b] = expected.get((t, a, b), 0) + 1
    got = co.cooccurrence(events(spark, history), NOW, wide=wide, chunk=chunk)
    assert rows(got, *PAIR, "co_count") == sorted(
        (*k, n) for k, n in expected.items() if n >= 3)


def test_wide_customer_lists_nothing_alone(spark):
    """One customer with a third of the rows adds to others' pairs but lists none."""
    hot = [("A", "hot", BUY, f"p{i}", NOW - HOUR * i) for i in range(40)]
    rest = []
    for c in ("x", "y"):
        rest += [("A", c, BUY, "p5", NOW - 2 * DAY), ("A", c, BUY, "p1", NOW - DAY)]
    got = co.cooccurrence(events(spark, hot + rest), NOW, wide=10, chunk=5)
    assert rows(got, *PAIR, "co_count") == [("A", "p5", "p1", 3)]


def test_related_products_order(spark):
    rules = cooc(spark, [("A", "x", "b", 5, 0.5), ("A", "x", "a", 5, 0.5),
                         ("A", "x", "c", 6, 0.5), ("A", "x", "d", 3, 0.9), ("B", "x", "z", 3, 1.0)])
    got = co.related_products(rules, 3).filter("tenant_id = 'A'").orderBy("rank")
    assert [r.product_id for r in got.collect()] == ["d", "c", "a"]


def test_related_for_anchors_keeps_columns(spark):
    rules = cooc(spark, [("A", "x", "b", 5, 0.5), ("A", "x", "c", 3, 0.2), ("B", "x", "z", 3, 1.0)])
    anchors = spark.createDataFrame([("A", "u", "x")],
                                    "tenant_id STRING, customer_id STRING, product_id STRING")
    got = co.related_for_anchors(anchors, rules)
    assert rows(got, "customer_id", "anchor_product_id", "product_id") == [
        ("u", "x", "b"), ("u", "x", "c")]
    assert rows(co.related_for_anchors(anchors, rules, k=1), "product_id") == [("b",)]


def test_support_counts_buyers_once(spark):
    ev = events(spark, [("A", "u", BUY, "p", NOW), ("A", "u", BUY, "p", NOW - DAY),
                        ("A", "v", BUY, "p", NOW), ("A", "v", "click", "q", NOW)])
    got = co.product_support(ev)
    assert rows(got, "product_id", F.col("customer_support")) == [("p", 2)]


def test_wide_customers_are_asked_about_what_they_may_hold(spark):
    """Every pair of the narrow customers travelled for every product of every wide one."""
    from pyspark.sql import functions as F

    both = F.expr("shiftleft(1L, cast(pmod(xxhash64(product_id), 64L) as int))")
    bits = {f"p{i}": spark.sql(f"SELECT 'p{i}' AS product_id").select(both).first()[0] for i in range(40)}
    slots = [("A", f"n{i}", p, 0, 1, 2) for i in range(3) for p in ("p0", "p1")] + [("A", "w", f"p{i}", 0, 1, 2) for i in range(40) if bits[f"p{i}"] != bits["p1"]]
    slots = spark.createDataFrame(slots, "tenant_id STRING, customer_id STRING, product_id STRING, slot BIGINT, first_us BIGINT, last_us BIGINT")
    found = co.pair_support(slots, 3, wide=2, chunk=10)
    assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.product_a_id, r.product_b_id, r.co_count) for r in found.collect()) == [("p0", "p1", 3), ("p1", "p0", 3)]
    more = slots.unionByName(spark.createDataFrame([("A", "w", "p1", 1, 5, 5)], slots.schema))
    found = co.pair_support(more, 3, wide=2, chunk=10)
    assert sorted((r.product_a_id, r.product_b_id, r.co_count) for r in found.collect()) == [("p0", "p1", 4), ("p1", "p0", 3)]
