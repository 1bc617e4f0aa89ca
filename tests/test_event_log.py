"""The replayable log: offsets, bounded batches, restarts, replays."""

import json

import pytest
from pyspark.sql import functions as F

from basketry.sources import lake
from basketry.streaming import event_log, jobs, sources
from tests.builders import MICRO, MINUTE, NOW, events, rows


def some(spark, start, n):
    return events(spark, [("A", f"c{i % 5}", "click", "p", NOW + i * MINUTE + i * MICRO) for i in range(start, start + n)]).withColumn(
        "id", F.concat(F.lit(f"{start}-"), "id"))


def ingest(spark, log, out, mark, most=7, starting=None, batches=None):
    """Run until all is read, or for some batches; returns the rows of every batch."""
    stream = sources.decode_messages(event_log.log_records(spark, log, f"{mark}-progress/at.json", most, starting))
    query = jobs.start_ingest(stream, out, mark, interval="0 seconds")
    if batches is None:
        query.processAllAvailable()
    else:
        while len([p for p in query.recentProgress if p.numInputRows]) < batches:
            query.processAllAvailable() if query.exception() else query.awaitTermination(1)
    query.stop()
    return [p.numInputRows for p in query.recentProgress if p.numInputRows]


def ids(spark, out):
    return sorted(r.id for r in lake.read_events(spark, out).collect())


@pytest.fixture()
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    for start in (0, 40):
        event_log.append(event_log.event_records(some(spark, start, 40)), path, 3)
    return path


def test_offsets_count_up_within_a_partition(spark, log):
    held = spark.read.parquet(f"{log}/data/*/*").count()
    last = event_log._commit_of(event_log.qualified(spark, log), 2)
    assert held == 80 == sum(last["ends"]) and len(last["ends"]) == 3
    first = event_log._commit_of(event_log.qualified(spark, log), 1)
    assert first["ends"] == last["starts"] and first["starts"] == [0, 0, 0]


def test_bounded_batches_restart_and_new_records(spark, log, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    sizes = ingest(spark, log, out, mark)
    assert sum(sizes) == 80 and max(sizes) <= 21 and len(sizes) >= 4
    assert ingest(spark, log, out, mark) == []
    event_log.append(event_log.event_records(some(spark, 80, 30)), log)
    assert sum(ingest(spark, log, out, mark)) == 30
    assert rows(lake.read_events(spark, out), "timestamp") == [((NOW + i * (MINUTE + MICRO)).replace(tzinfo=None),) for i in range(110)]
    want = sorted(f"{s}-e{i}" for s, n in ((0, 40), (40, 40), (80, 30)) for i in range(n))
    assert ids(spark, out) == want


def test_a_run_that_stops_goes_on_where_it_was(spark, log, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest(spark, log, out, mark, most=2, batches=2)
    ingest(spark, log, out, mark, most=2)
    assert ids(spark, out) == sorted(f"{s}-e{i}" for s in (0, 40) for i in range(40))


def test_replay_from_an_offset(spark, log, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest(spark, log, out, mark)
    again, starts = str(tmp_path / "again"), event_log._commit_of(event_log.qualified(spark, log), 2)["starts"]
    ingest(spark, log, again, str(tmp_path / "mark2"), starting=starts)
    assert ids(spark, again) == sorted(f"40-e{i}" for i in range(40))
    whole = str(tmp_path / "whole")
    ingest(spark, log, whole, str(tmp_path / "mark3"), most=1000)
    assert rows(lake.read_events(spark, whole), "id", "customer_id") == rows(lake.read_events(spark, out), "id", "customer_id")


def test_a_write_that_broke_off_is_not_in_the_log(spark, log, tmp_path):
    (tmp_path / "log" / "v=3").mkdir()
    (tmp_path / "log" / "v=3" / "commit.json").write_text(json.dumps({"write": "x", "starts": [9] * 3, "ends": [99] * 3}))
    out = str(tmp_path / "out")
    assert sum(ingest(spark, log, out, str(tmp_path / "mark"), most=100)) == 80
    assert event_log.append(event_log.event_records(some(spark, 80, 5)), log) == 4
