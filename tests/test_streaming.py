import json

from basketry.operators import reports, sessions
from basketry.sources import lake
from basketry.streaming import jobs, sources
from tests.builders import DAY, HOUR, MINUTE, NOW, events, rows


def arrive(spark, path, *batches):
    """Each batch becomes one file, in this order."""
    for rows_ in batches:
        events(spark, rows_).coalesce(1).write.mode("append").parquet(path)


def clicks(n, start=0, step=MINUTE):
    return [("A", f"c{i % 3}", "click", "p", NOW + (start + i) * step) for i in range(n)]


def finish(query):
    query.awaitTermination()


def test_ingest_is_replayable(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    arrive(spark, src, clicks(5))
    finish(jobs.start_ingest(sources.file_events(spark, src), out, mark))
    arrive(spark, src, clicks(4, start=10))
    finish(jobs.start_ingest(sources.file_events(spark, src), out, mark))
    finish(jobs.start_ingest(sources.file_events(spark, src), out, mark))
    assert lake.read_events(spark, out).count() == 9


def test_dedup_over_files(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    arrive(spark, src, clicks(5), clicks(5))
    stream = sources.file_events(spark, src, files_per_batch=1)
    finish(jobs.start_append(jobs.deduplicate_stream(stream), out, mark))
    assert rows(spark.read.parquet(out), "id") == [(f"e{i}",) for i in range(5)]


def test_windows_equal_the_batch_job(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    arrive(spark, src, clicks(20), clicks(20, start=3))
    stream = sources.file_events(spark, src, files_per_batch=1)
    finish(jobs.start_upserts(jobs.stream_5m_features(stream, "1 hour"), out, mark))
    keys = ["tenant_id", "customer_id", "window_start"]
    got = jobs.latest_upserts(spark, out, keys)
    batch = reports.sliding_5m_features(spark.read.parquet(src))
    assert rows(got, *batch.columns) == rows(batch, *batch.columns)


def test_days_equal_the_batch_job(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    arrive(spark, src, clicks(9, step=DAY / 4), clicks(9, start=5, step=DAY / 4))
    stream = sources.file_events(spark, src, files_per_batch=1)
    finish(jobs.start_upserts(jobs.stream_daily_activity(stream, "3 days"), out, mark))
    got = jobs.latest_upserts(spark, out, ["tenant_id", "day"])
    batch = reports.daily_activity(spark.read.parquet(src))
    assert rows(got, *batch.columns) == rows(batch, *batch.columns)


def test_sessions_before_the_watermark_equal_the_batch_job(spark, tmp_path):
    jobs.configure_streaming(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    arrive(spark, src, clicks(12, step=7 * MINUTE), clicks(6, start=60, step=7 * MINUTE),
           [("A", "sentinel", "click", None, NOW + 100 * HOUR)])
    stream = sources.file_events(spark, src, files_per_batch=1)
    finish(jobs.start_append(jobs.stream_sessions(stream), out, mark))
    columns = ["customer_id", "session_start", "session_end", "events", "product_events"]
    batch = sessions.session_windows(spark.read.parquet(src)).filter("customer_id <> 'sentinel'")
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)


def test_messages(spark):
    good = {"id": "e", "tenant_id": "A", "customer_id": "c", "event_type": "click",
            "product_id": None, "properties": "{}", "timestamp": "2025-11-02T10:15:00Z"}
    messages = spark.createDataFrame(
        [(json.dumps(good).encode(),), (b"rubbish",)], "value BINARY")
    assert rows(sources.decode_messages(messages), "id", "event_type") == [("e", "click")]


def test_incomplete_events_are_set_aside(spark, tmp_path):
    rows_in = [("A", "c", "click", None, NOW), ("", "c", "click", None, NOW),
               ("A", None, "click", None, NOW), ("A", "c", None, None, NOW)]
    src, out, bad = (str(tmp_path / x) for x in ("src", "out", "bad"))
    events(spark, rows_in).write.parquet(src)
    finish(jobs.start_ingest(sources.file_events(spark, src), out, out + "-mark"))
    finish(jobs.start_rejects(sources.file_events(spark, src), bad, bad + "-mark"))
    assert rows(spark.read.parquet(out), "id") == [("e0",)]
    assert rows(spark.read.parquet(bad), "id") == [("e1",), ("e2",), ("e3",)]
    messages = spark.createDataFrame([(b"rubbish",), (b'{"id": "x"}',)], "value BINARY")
    assert sources.undecoded_messages(messages).count() == 2
