import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates as cand
from basketry.operators import cooccurrence as co
from basketry.operators import decisions as dec
from basketry.operators import requests as req
from basketry.plans import recommend as plan
from tests.builders import (
    DAY, HOUR, NOW, cooc, events, features, products, requests, rows, warm,
)


def run(spark, asked, catalogue, history, rules, scores):
    out = plan.recommend(
        requests(spark, asked), events(spark, history), products(spark, catalogue),
        features(spark, scores), cooc(spark, rules), NOW,
    )
    return [
        (r.tenant_id, r.customer_id, r.rank, r.product_id, r.score, r.reason)
        for r in out.orderBy("tenant_id", "customer_id", "request_id", "rank").collect()
    ]


def test_warm_customer(spark):
    got = run(spark, [("A", "cust", 5, [])], *warm(spark))
    assert [g[2:] for g in got] == [
        (1, "earbuds", 5.72, "blended"), (2, "charger", 5.64, "blended"),
        (3, "phone", 5.4, "category_affinity"), (4, "case", 2.56, "blended"),
    ]


def test_second_warm_fixture(spark):
    catalogue, history, _, scores = warm(spark)
    rules = [("A", "phone", "earbuds", 5, 0.80), ("A", "phone", "case", 3, 0.45)]
    got = run(spark, [("A", "cust", 5, [])],
              [c for c in catalogue if c[0] in ("phone", "earbuds", "case")],
              history, rules, scores)
    assert [g[3:] for g in got] == [
        ("earbuds", 5.72, "blended"), ("phone", 5.4, "category_affinity"),
        ("case", 2.58, "blended"),
    ]


def test_exclusions_and_limit(spark):
    got = run(spark, [("A", "cust", 5, ["earbuds"]), ("A", "cust", 2, [])], *warm(spark))
    assert [g[3] for g in got] == ["charger", "phone", "case", "earbuds", "charger"]


def test_missing_limit_and_exclusions_get_defaults(spark):
    got = run(spark, [("A", "cust", None, None)], *warm(spark))
    assert len(got) == 4


def test_tenants_do_not_mix(spark):
    catalogue, history, rules, scores = warm(spark)
    got = run(
        spark, [("A", "cust", 5, []), ("B", "cust", 5, [])],
        catalogue + [("tv", "B", "electronics")], history, rules,
        scores + [("B", "cust", {"electronics": 99.0})],
    )
    assert [g[3] for g in got if g[0] == "A"] == ["earbuds", "charger", "phone", "case"]
    assert [g[3:] for g in got if g[0] == "B"] == [("tv", 59.4, "category_affinity")]


def popular_history():
    views = [("A", f"v{i}", "product_view", "popular_1", NOW - i * HOUR) for i in range(5)]
    buys = [("A", f"b{i}", "purchase", "popular_2", NOW - i * HOUR) for i in range(3)]
    old = [("A", "x", "purchase", "popular_1", NOW - 31 * DAY)]
    return views + buys + old


def test_cold_start(spark):
    catalogue = [("popular_1", "A", "c"), ("popular_2", "A", "c")]
    got = run(spark, [("A", "nobody", 5, [])], catalogue, popular_history(), [], [])
    assert [g[3:] for g in got] == [
        ("popular_2", 15.0, "global_popularity"), ("popular_1", 5.0, "global_popularity"),
    ]


def test_all_candidates_excluded_falls_back(spark):
    catalogue, history, rules, scores = warm(spark)
    everything = ["phone", "earbuds", "charger", "case"]
    got = run(spark, [("A", "cust", 5, everything)],
              catalogue + [("popular_2", "A", "c")],
              history + popular_history()[5:8], rules, scores)
    assert [g[3:] for g in got] == [("popular_2", 15.0, "global_popularity")]


def test_fallback_cuts_before_exclusions(spark):
    catalogue = [(f"p{i}", "A", "c") for i in range(5)]
    history = [("A", f"v{j}", "product_view", f"p{i}", NOW - HOUR)
               for i in range(5) for j in range(5 - i)]
    got = run(spark, [("A", "nobody", 1, ["p0", "p1", "p2"])], catalogue, history, [], [])
    assert got == []


def test_zero_score_category_keeps_its_reason(spark):
    catalogue, history, rules, _ = warm(spark)
    got = run(spark, [("A", "cust", 5, [])], catalogue, history, rules,
              [("A", "cust", {"electronics": 0.0})])
    assert ("earbuds", 0.32, "category_affinity") in [g[3:] for g in got]
    assert ("case", 0.16, "cooccurrence") in [g[3:] for g in got]


def test_inactive_products(spark):
    catalogue = [("phone", "A", "e"), ("dead", "A", "e", False), ("old", "A", "x", False)]
    history = [("A", "cust", "product_view", "phone", NOW - DAY)]
    got = run(spark, [("A", "cust", 5, [])], catalogue, history,
              [("A", "phone", "old", 3, 0.5)], [("A", "cust", {"e": 3.0})])
    assert [g[3] for g in got] == ["phone", "old"]


def test_affinity_stops_at_one_hundred_over_tied_categories(spark):
    catalogue = [(f"{c}{i:03d}", "A", c) for c in "abc" for i in range(70)]
    scores = features(spark, [("A", "cust", {"a": 5.0, "b": 3.0, "c": 3.0})])
    got = cand.affinity_candidates(scores, products(spark, catalogue))
    expected = sorted(
        ((-5.0 if c == "a" else -3.0), p) for p, _, c in catalogue
    )[:100]
    assert rows(got, -F.col("category_score"), "product_id") == expected


@pytest.mark.parametrize("block,top,limit", [(1, 3, 3), (64, 10, 8), (2, 10, 1), (1, 100, 3)])
def test_pruned_rows_rank_like_all_rows(spark, monkeypatch, block, top, limit):
    """Many pairs per anchor, ties within and over categories, scores that round alike,
    exclusions: leaving out rows that cannot be shown changes nothing."""
    monkeypatch.setattr(plan, "BLOCK", block)
    monkeypatch.setattr(plan, "TOP", top)
    pick = random.Random(block * 100 + limit)
    ids = [f"p{i:02d}" for i in range(40)]
    catalogue = [(p, "A", f"c{pick.randrange(5)}", pick.random() > 0.15) for p in ids]
    rules = [("A", a, b, 3, pick.randrange(1, 11) / 10)
             for a in ids for b in ids if a != b and pick.random() < 0.5]
    history, scores, asked = [], [], []
    for c in range(14):
        history += [("A", f"u{c}", "product_view", p, NOW - (k + 1) * HOUR)
                    for k, p in enumerate(pick.sample(ids, pick.randrange(0, 6)))]
        if c % 7:
            some = pick.sample(range(5), pick.randrange(1, 6))
            scores.append(("A", f"u{c}", {
                f"c{g}": pick.choice([0.0, 0.25, 0.5, 0.50001, 1.0, 1.0, 3.0]) for g in some}))
        asked.append(("A", f"u{c}", limit, pick.sample(ids, pick.choice([0, 0, 2, 10, 30]))))
    ev, pr, fe = events(spark, history), products(spark, catalogue), features(spark, scores)
    ru, rq = cooc(spark, rules), requests(spark, asked)
    got = plan.recommend(rq, ev, pr, fe, ru, NOW)

    anchors = cand.recent_anchors(ev, NOW).select("tenant_id", "customer_id", "product_id")
    related = co.related_for_anchors(
        rq.select("tenant_id", "customer_id", "request_id")
        .join(anchors, ["tenant_id", "customer_id"]), ru)
    affinity = cand.affinity_candidates(req.feature_lookup(rq, fe), pr, top, keys=req.REQUEST)
    kept = req.exclude_products(cand.blend_candidates(affinity, related), rq)
    popular = cand.popularity(ev, pr, NOW, 150)
    plain = kept.unionByName(cand.popularity_fallback(rq, kept, popular))
    columns = ["request_id", "rank", "product_id", "score", "reason"]
    assert rows(got, *columns) == rows(cand.rank_candidates(plain, rq), *columns)


def test_anchor_is_not_its_own_candidate(spark):
    rq = requests(spark, [("A", "cust", 5, [])])
    pairs = spark.createDataFrame(
        [("A", "r0", "x", "x"), ("A", "r0", "x", "y")],
        "tenant_id STRING, request_id STRING, anchor_product_id STRING, product_id STRING",
    )
    assert rows(req.exclude_products(pairs, rq), "product_id") == [("y",)]


def test_check_requests(spark):
    asked = requests(spark, [
        ("A", "ok", 50, []), ("A", "many", 51, []), ("A", "few", 0, []), ("A", "", 5, []),
        ("A", "x" * 201, 5, []), ("A", "fill", None, None), ("A", None, 5, []),
    ])
    valid, invalid = req.check_requests(asked)
    assert rows(valid, "customer_id", "limit") == [("fill", 8), ("ok", 50)]
    assert invalid.count() == 5


def test_decision_log(spark):
    asked = requests(spark, [("A", "cust", 2, []), ("A", "nobody", 5, [])])
    catalogue, history, rules, scores = warm(spark)
    recs = plan.recommend(asked, events(spark, history), products(spark, catalogue),
                          features(spark, scores), cooc(spark, rules), NOW)
    recs = recs.filter("customer_id = 'cust'")
    log = dec.log_decisions(recs, asked, NOW, latency_ms=F.lit(1.239)).orderBy("customer_id")
    first, second = log.collect()
    assert [tuple(i) for i in first.response_items] == [
        ("earbuds", 5.72, "blended"), ("charger", 5.64, "blended")]
    assert second.response_items == []
    assert first.latency_ms == 1.24 and first.model_version == "v1-blended-heuristic"
    again = dec.log_decisions(recs, asked, NOW).orderBy("customer_id").collect()
    assert [r.decision_id for r in again] == [first.decision_id, second.decision_id]
    assert first.decision_id != second.decision_id


def test_invalidation_drops_whole_lists(spark):
    recs = spark.createDataFrame(
        [("A", "u", "home", "p"), ("A", "u", "home", "q"), ("A", "w", "home", "q"),
         ("B", "u", "home", "p")],
        "tenant_id STRING, customer_id STRING, surface STRING, product_id STRING")
    changed = products(spark, [("p", "A", "c")])
    left = plan.invalidate_recommendations(recs, changed)
    assert rows(left, "tenant_id", "customer_id") == [("A", "w"), ("B", "u")]


def test_precompute_takes_the_last_day(spark):
    history = [("A", "new", "click", None, NOW - 24 * HOUR),
               ("A", "old", "click", None, NOW - 25 * HOUR)]
    assert rows(plan.precompute_requests(events(spark, history), NOW), "customer_id") == [("new",)]


def test_a_limit_out_of_range_is_refused_not_shortened(spark):
    catalogue = products(spark, [(f"p{i:03}", "A", "c") for i in range(90)])
    seen = events(spark, [("A", "x", "product_view", f"p{i:03}", NOW - HOUR) for i in range(90)])
    asked = requests(spark, [("A", "x", 80, []), ("A", "y", 50, []), ("A", "z", 0, [])])
    got = plan.recommend(asked, seen, catalogue, features(spark, []), cooc(spark, []), NOW)
    assert rows(got.groupBy("customer_id").count(), "customer_id", "count") == [("y", 50)]
    assert rows(req.check_requests(asked)[1], "customer_id") == [("x",), ("z",)]
    with pytest.raises(ValueError):
        plan.precompute_requests(seen, NOW, limit=80)


def test_tied_categories_stay_linear(spark):
    """A thousand categories of one score: one list per request, and rows in the order of ids."""
    names = [f"c{i:04}" for i in range(1000)]
    catalogue = products(spark, [(f"p{(i * 7) % 1000:04}", "A", c) for i, c in enumerate(names)])
    asked = requests(spark, [("A", "x", 8, []), ("A", "y", 8, [])])
    scores = features(spark, [("A", who, {c: 0.0 for c in names}) for who in "xy"])
    leaders = cand.category_leaders(catalogue, 100)
    found = plan.request_categories(asked, scores, leaders)
    assert found.count() == 2000
    assert "tied" not in found.columns
    got = plan.recommend(asked, events(spark, []), catalogue, scores, cooc(spark, []), NOW)
    assert rows(got.filter("customer_id = 'x'"), "rank", "product_id") == [
        (i + 1, f"p{i:04}") for i in range(8)
    ]
