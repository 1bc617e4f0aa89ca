"""Per-event counts on a stream: restarts, late events, ties."""

import random

import pytest

from basketry.operators import reports
from basketry.streaming import jobs, rolling, sources
from tests.builders import MICRO, MINUTE, NOW, events, rows


MINUTE_US = 60_000_000


def arrive(spark, path, *batches):
    for rows_ in batches:
        events(spark, rows_).coalesce(1).write.mode("append").parquet(path)


def random_events(n, start=0, span=60, seed=1):
    draw = random.Random(seed)
    kinds = ["page_view", "product_view", "click", "purchase"]
    times = [NOW + start * MINUTE + draw.choice([0, 1, 5, 10, draw.randrange(span)]) * MINUTE + draw.choice([0, 0, 1]) * MICRO for _ in range(n)]
    return [("A", f"c{draw.randrange(3)}", draw.choice(kinds), "p", t) for t in times]


def run(spark, src, out, mark, delay, period="10 minutes"):
    stream = sources.file_events(spark, src, files_per_batch=1)
    jobs.start_append(rolling.stream_rolling_5m(stream, delay, period), out, mark).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("period", ["5 minutes", "10 minutes", "7 minutes"])
def test_rows_equal_the_batch_job_over_restarts(spark, tmp_path, period):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    arrive(spark, src, random_events(60, 0, seed=1), random_events(60, 20, seed=2))
    first = rows(run(spark, src, out, mark, "2 hours", period), "id")
    arrive(spark, src, random_events(60, 70, seed=3), [("A", "z", "click", None, NOW + 500 * MINUTE)])
    got = run(spark, src, out, mark, "2 hours", period)
    whole = reports.rolling_5m_features(spark.read.parquet(src))
    assert len(first) < got.count() == 180
    assert rows(got, *whole.columns) == rows(whole.where("customer_id <> 'z'"), *whole.columns)
    left = rolling.rolling_left(spark.read.parquet(src), got)
    assert rows(left, "customer_id") == [("z",)]
    again = run(spark, src, out, mark, "2 hours", period)
    assert again.count() == 180


def test_late_events_count_within_the_delay_only(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    click = lambda minute, name="c": ("A", name, "click", "p", NOW + minute * MINUTE)
    arrive(spark, src, [click(0), click(3)])
    arrive(spark, src, [click(18, "other")])  # the watermark goes to minute 8
    arrive(spark, src, [click(2), click(9)])  # two is too late, nine is not
    arrive(spark, src, [click(11)], [click(60, "end")], [click(200, "end")])
    got = run(spark, src, out, mark, "10 minutes").where("customer_id = 'c'")
    minutes = {(r.timestamp - NOW.replace(tzinfo=None)).seconds // 60: r.last_5m_clicks for r in got.collect()}
    assert minutes == {0: 1, 3: 2, 9: 1, 11: 2}


def test_windows_of_ties():
    import numpy as np

    us = np.array([0, 0, 5, rolling.WIDTH_US, rolling.WIDTH_US + 5])
    found = rolling.windows_of(us, np.array([1, 2, 5, 2, 1]), us)
    assert found["last_5m_views"].tolist() == [1, 1, 2, 1, 1]
    assert found["last_5m_clicks"].tolist() == [1, 1, 1, 1, 1]
    assert found["last_5m_product_views"].tolist() == [0, 0, 1, 1, 0]


def test_customers_of_one_state_are_counted_apart():
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(3)
    us = draw.integers(0, 3 * rolling.WIDTH_US, 400) // MINUTE_US * MINUTE_US
    held = pd.DataFrame({
        "customer_id": draw.choice(np.array(["a", "b", None], object), 400), "tenant_id": draw.choice(np.array(["t", None], object), 400),
        "id": [str(i) for i in range(400)], "us": us, "counts": draw.choice([0, 1, 2, 5], 400), "own": draw.random(400) < 0.8,
    })
    got = rolling.rolled(held).set_index("id")
    assert len(got) == held["own"].sum()
    for r in held[held["own"]].itertuples():
        near = held[(held["customer_id"].isna() if r.customer_id is None else held["customer_id"] == r.customer_id)
                    & (held["tenant_id"].isna() if r.tenant_id is None else held["tenant_id"] == r.tenant_id)
                    & (held["us"] <= r.us) & (held["us"] > r.us - rolling.WIDTH_US)]
        for name, bit in rolling.COUNTS.items():
            assert got.loc[r.id, name] == ((near["counts"] & bit) > 0).sum()


def test_customers_share_states(spark, tmp_path):
    """A state for every customer made as many calls to the store as there are events."""
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    people = [("A", f"c{n}", "click", "p", NOW + (n % 2) * MINUTE) for n in range(300)]
    arrive(spark, src, people, [("A", "end", "click", "p", NOW + 90 * MINUTE)])
    stream = sources.file_events(spark, src, files_per_batch=1)
    query = jobs.start_append(rolling.stream_rolling_5m(stream, groups=4), out, mark)
    query.awaitTermination()
    written = sum(op["customMetrics"].get("rocksdbPutCount", 0) for p in query.recentProgress for op in p["stateOperators"])
    assert spark.read.parquet(out).where("last_5m_clicks = 1").count() == 300
    assert 0 < written < 100
