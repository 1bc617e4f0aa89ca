"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every query is
run once to warm up and then timed; each row it gives is computed (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketry.checks import queries as q
from basketry.operators import cooccurrence as co
from basketry.operators.ingest import ingest_events
from basketry.plans.customer_features import customer_features
from basketry.plans.feature_state import add_events
from basketry.plans.recommend import recommend
from basketry.session import local_session, materialize
from basketry.sources import testbed as tb


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    # The stored tables the serving jobs read; building them is timed as its own query.
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    features = materialize(customer_features(events, products, tb.AS_OF), "features")
    pairs = materialize(co.cooccurrence(events, tb.AS_OF), "pairs")
    asked = materialize(tb.requests(spark, sf_dir), "requests")
    bodies = materialize(tb.payloads(spark, sf_dir), "bodies")

    jobs = {
        "ingest": lambda: ingest_events(bodies, uuid_ids=False)[0],
        "customer_features": lambda: customer_features(events, products, tb.AS_OF),
        "cooccurrence": lambda: co.cooccurrence(events, tb.AS_OF),
        "recommend": lambda: recommend(asked, events, products, features, pairs, tb.AS_OF),
    }
    for name in ("activity_counts", "category_affinity", "session_stats", "sessionized_events",
                 "purchase_revenue", "candidate_pairs", "recent_anchors", "popularity",
                 "affinity_candidates", "related_for_anchors", "incremental_feature_rows",
                 "rolling_5m_features", "latency_summary", "daily_activity"):
        jobs[name] = lambda name=name: q.QUERIES[name](spark, sf_dir)

    # A batch of new events added to stored state; each run has a state of its own.
    stored = iter([q.stored_state(spark, sf_dir) for _ in range(2)])

    def added():
        new, catalogue, roots = next(stored)
        return add_events(new, catalogue, *roots, tb.AS_OF, "new")

    jobs["state_increment"] = added
    seconds = {}
    for name, run in jobs.items():
        timed(run)
        seconds[name] = round(timed(run), 3)

    n_events, n_asked = events.count(), asked.count()
    n_bodies = ingest_events(bodies, uuid_ids=False)[0].count()
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "throughput": {
            "ingest_events_per_sec": round(n_bodies / seconds["ingest"]),
            "feature_events_per_sec": round(n_events / seconds["customer_features"]),
            "cooccurrence_events_per_sec": round(n_events / seconds["cooccurrence"]),
            "recommend_requests_per_sec": round(n_asked / seconds["recommend"]),
        },
    }))


if __name__ == "__main__":
    main()
