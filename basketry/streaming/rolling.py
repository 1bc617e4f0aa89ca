"""Per-event five-minute counts on a stream, by keyed state that event time clears."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basketry.functions.expressions import is_type, is_view, micros_of, time_slot
from basketry.operators.reports import rolling_5m_features
from basketry.schemas import CUSTOMER

WIDTH_US = micros_of("5 minutes")
# What an event counts for.
VIEW, CLICK, PRODUCT_VIEW = 1, 2, 4
COUNTS = {"last_5m_views": VIEW, "last_5m_clicks": CLICK, "last_5m_product_views": PRODUCT_VIEW}
HELD_TYPES = pa.schema([("customer_id", pa.string()), ("tenant_id", pa.string()), ("id", pa.string()), ("us", pa.int64()), ("counts", pa.int32()), ("own", pa.bool_())])
HELD = HELD_TYPES.names
ROLLED = "customer_id STRING, tenant_id STRING, id STRING, us LONG, " + ", ".join(f"{c} LONG" for c in COUNTS)
GROUPS = 8


# The processor travels as code, since the worker that prepares it does not see files added to the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def windows_of(us: np.ndarray, counts: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """For each time in ``at`` the counts of the events in the five minutes up to it; ``us`` ascends."""
    first, end = np.searchsorted(us, at - WIDTH_US, "right"), np.searchsorted(us, at, "right")
    out = {}
    for name, bit in COUNTS.items():
        so_far = np.concatenate([[0], np.cumsum((counts & bit) > 0)])
        out[name] = so_far[end] - so_far[first]
    return out


def rolled(held: pd.DataFrame) -> pd.DataFrame:
    """The own events of ``held``, each with the counts of its customer's five minutes.

    All customers are counted at once: each has a stretch of time of its own on one long line,
    further than five minutes from the next.
    """
    customer = held.groupby(["customer_id", "tenant_id"], dropna=False, sort=False).ngroup().to_numpy(np.int64)
    us, counts = held["us"].to_numpy(np.int64), held["counts"].to_numpy(np.int64)
    span = us.max() - us.min() + WIDTH_US + 1
    line = customer * span + (us - us.min())
    order = np.argsort(line, kind="stable")
    mine = order[held["own"].to_numpy(bool)[order]]
    found = windows_of(line[order], counts[order], line[mine])
    return held.iloc[mine][HELD[:4]].assign(**found)


class _Rolling(StatefulProcessor):
    """Holds the events of a group of customers of one period and of the five minutes before it.

    When event time has passed the period, no event of either can still come: the period's own
    events are returned with their counts, and the state goes. A batch's events of a key are held
    as one value, so the calls to the state are as many as keys, not as events.
    """

    def __init__(self, period_us: int) -> None:
        self._period_us = period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._events = handle.getListState("events", "rows BINARY")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [frame.loc[frame["us"] > passed, HELD] for frame in rows]
        kept = [frame for frame in kept if len(frame)]
        if kept:
            table = pa.Table.from_pandas(pd.concat(kept), HELD_TYPES, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, HELD_TYPES) as out:
                out.write_table(table)
            self._events.appendValue((sink.getvalue().to_pybytes(),))
            self._handle.registerTimer((int(key[1]) + 1) * self._period_us // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(bytes(value[0])).read_all() for value in self._events.get()]
        self._events.clear()
        rows = rolled(pa.concat_tables(held).to_pandas()) if held else ()
        if len(rows):
            yield rows

    def close(self) -> None:
        pass


def stream_rolling_5m(events: DataFrame, delay: str = "10 minutes", period: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """The rows of ``rolling_5m_features`` from a stream, each once the watermark has passed its period.

    Needs the RocksDB state store (``configure_streaming``) and append mode. Time is cut into
    periods of at least five minutes; an event is sent to its own and, if it is in the last five
    minutes, to the next. Customers are dealt to ``groups``, and a key's state is a period and five
    minutes of one group: there are as many keys as groups and periods, however many customers
    there are. A short period gives rows sooner, a long one needs fewer keys; more groups make
    smaller states. Events later than ``delay`` are left out of all counts; with the
    events of periods still open when the stream stops they come from ``rolling_left``. Events without
    a time are left out.
    """
    period_us = micros_of(period)
    if period_us < WIDTH_US:
        raise ValueError("a period has at least five minutes")
    us = F.unix_micros("timestamp")
    counts = F.when(is_view(), VIEW).otherwise(0) + F.when(is_type("click"), CLICK).otherwise(0)
    counts = counts + F.when(is_type("product_view"), PRODUCT_VIEW).otherwise(0)
    own, after = (F.struct((time_slot(us, period_us) + k).alias("period"), F.lit(k == 0).alias("own")) for k in (0, 1))
    sent = F.explode(F.when(F.pmod(us, F.lit(period_us)) > period_us - WIDTH_US, F.array(own, after)).otherwise(F.array(own)))
    group = F.pmod(F.xxhash64(*CUSTOMER), F.lit(groups)).cast("int")
    placed = events.where("timestamp is not null").withWatermark("timestamp", delay).select(
        *CUSTOMER, "id", "timestamp", us.alias("us"), counts.alias("counts"), group.alias("group"), sent.alias("at")
    )
    keyed = placed.select("group", "at.period", *CUSTOMER, "id", "timestamp", "us", "counts", "at.own").groupBy("group", "period")
    counted = keyed.transformWithStateInPandas(_Rolling(period_us), ROLLED, "Append", "EventTime")
    return counted.select(*CUSTOMER, "id", F.timestamp_micros("us").alias("timestamp"), *COUNTS)


def rolling_left(events: DataFrame, emitted: DataFrame) -> DataFrame:
    """The rows of ``events`` that the stream has not emitted as they are, a batch pass over the raw lake."""
    whole = rolling_5m_features(events)
    return whole.join(emitted.select(*whole.columns), whole.columns, "left_anti")
