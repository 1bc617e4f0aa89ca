"""How candidate lists are made."""

import re

from pyspark.sql import functions as F

from basketry.operators import candidates as cand


def test_popular_lists_meet_the_requests_where_these_are(spark):
    """One task made all rows of all requests when the requests were sent to the few lists."""
    asked = spark.range(5000, numPartitions=4).select(
        F.lit("A").alias("tenant_id"), F.col("id").cast("string").alias("request_id"), F.lit(2).alias("limit"), F.array().cast("array<string>").alias("exclude_product_ids")
    )
    popular = spark.createDataFrame([("A", i, f"p{i}", 9.0 - i) for i in range(1, 9)], "tenant_id STRING, rank INT, product_id STRING, score DOUBLE")
    found = cand.popularity_fallback(asked, asked.where("false"), popular)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"rightHint=\(strategy=broadcast\)", plan)
    assert found.count() == 5000 * 6


def test_lists_of_a_key_are_ordered_without_a_sort_of_their_products(spark):
    names = "tenant_id STRING, category STRING, product_id STRING"
    leaders = spark.createDataFrame([("A", c, p) for c, ps in {"x": ["1", "5"], "y": ["2", "4"], "z": ["3"], "w": ["0"]}.items() for p in ps], names)
    scores = spark.createDataFrame(
        [("A", "c", "x", 2.0), ("A", "c", "y", 2.0), ("A", "c", "z", 3.0), ("A", "c", "w", 0.0), ("A", None, "z", 0.0)],
        "tenant_id STRING, customer_id STRING, category STRING, affinity_score DOUBLE",
    )
    found = cand.expand_categories(scores, leaders, 5, ["tenant_id", "customer_id"])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.rank, r.product_id, r.category_score) for r in found.where("customer_id = 'c'").collect())
    assert got == [(1, "3", 3.0), (2, "1", 2.0), (3, "2", 2.0), (4, "4", 2.0), (5, "5", 2.0)]
    assert [(r.rank, r.product_id, str(r.category_score)) for r in found.where("customer_id IS NULL").collect()] == [(1, "3", "0.0")]
