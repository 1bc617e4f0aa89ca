"""A stream joined with stored features of the newest version."""

from basketry import schemas
from basketry.operators import reports
from basketry.plans.customer_features import customer_features
from basketry.sources import tables
from basketry.streaming import jobs, merged, sources
from tests.builders import MINUTE, NOW, events, products, rows

COLUMNS = ["tenant_id", "customer_id", "total_views", "features_version"]


def arrive(spark, path, rows_):
    events(spark, rows_).coalesce(1).write.mode("append").parquet(path)


def views(n, start=0):
    return [("A", f"c{i % 3}", "page_view", "p", NOW + (start + i) * MINUTE) for i in range(n)]


def run(spark, src, root, out, mark):
    stream = jobs.stream_5m_features(sources.file_events(spark, src, files_per_batch=1), "1 hour")
    merged.start_merged_features(stream, root, out, mark).awaitTermination()
    return merged.latest_merged(spark, out)


def store(spark, src, root, customers=None):
    made = customer_features(spark.read.parquet(src), products(spark, []), NOW)
    made = made if customers is None else made.where(made.customer_id.isin(*customers))
    tables.upsert_table(made, root, schemas.CUSTOMER, schemas.CUSTOMER_FEATURES, ["tenant_id"])


def test_each_batch_sees_the_newest_version(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, root, out, mark = (str(tmp_path / n) for n in ("src", "features", "out", "mark"))
    arrive(spark, src, views(6))
    got = run(spark, src, root, out, mark)
    assert rows(got, *COLUMNS) == [("A", f"c{i}", None, 0) for i in range(3)]
    store(spark, src, root)
    arrive(spark, src, views(3, start=6))
    assert rows(run(spark, src, root, out, mark), *COLUMNS) == [("A", f"c{i}", 2, 1) for i in range(3)]
    store(spark, src, root, ["c1"])
    arrive(spark, src, views(2, start=9))
    # c2 has no event in the last batch and keeps what it had.
    assert rows(run(spark, src, root, out, mark), *COLUMNS) == [("A", "c0", 2, 2), ("A", "c1", 3, 2), ("A", "c2", 2, 1)]
    assert run(spark, src, root, out, mark).count() == 3


def test_rows_equal_the_batch_job(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, root, out, mark = (str(tmp_path / n) for n in ("src", "features", "out", "mark"))
    arrive(spark, src, views(20))
    arrive(spark, src, views(20, start=4))
    store(spark, src, root)
    got = run(spark, src, root, out, mark)
    every = spark.read.parquet(src)
    want = reports.merge_features(
        tables.current(spark, root, schemas.CUSTOMER_FEATURES), reports.latest_5m_features(reports.sliding_5m_features(every))
    )
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_plain_versions(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, root, out, mark = (str(tmp_path / n) for n in ("src", "features", "out", "mark"))
    arrive(spark, src, views(3))
    tables.publish(customer_features(spark.read.parquet(src), products(spark, []), NOW), root)
    assert rows(run(spark, src, root, out, mark), *COLUMNS) == [("A", f"c{i}", 1, 1) for i in range(3)]


def test_only_named_columns_are_read(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, root, out, mark = (str(tmp_path / n) for n in ("src", "features", "out", "mark"))
    arrive(spark, src, views(6))
    store(spark, src, root)
    whole = run(spark, src, root, out, mark)
    few = merged.latest_merged(spark, out, ["total_views", "streaming"])
    assert sorted(few.columns) == ["customer_id", "streaming", "tenant_id", "total_views"]
    assert "category_affinity" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, few.collect())) == sorted(map(repr, whole.select(*few.columns).collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
