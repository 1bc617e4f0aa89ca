"""An append-only log in a shared folder, and a streaming source that replays it by offset.

    root/data/<write>/part=<p>/*.parquet   records (offset, key, value, timestamp) of log partition p
    root/v=<n>/commit.json                 the write, and each partition's first offset and end
    root/v=<n>/_SUCCESS                    makes the records of the write part of the log

As in a message broker, a record's offset is its place in its partition, records of one key keep
their order, and readers name the offsets they want; nothing a reader does changes the log.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from basketry.sources.versions import DONE, fs_of, next_version, qualified, versions

# The source travels as code, so that it needs no package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD = "partition INT, offset LONG, key STRING, value STRING, timestamp TIMESTAMP"
FORMAT = "event_log"
# JSON times keep their microseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def append(records: DataFrame, root: str, partitions: int = 8, order_by: Sequence[str] = ("timestamp",)) -> int:
    """Add ``records`` (key, value, timestamp) to the log; returns the number of the write.

    A key always goes to the same of ``partitions`` (kept from the first write on). Of two writers
    that pick the same number the second fails; records of a write that broke off are not in the log.
    """
    spark = records.sparkSession
    found = versions(spark, root)
    ends = _commit_of(qualified(spark, root), found[-1])["ends"] if found else [0] * partitions
    partitions = len(ends)
    dealt = records.select("key", "value", "timestamp").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    first = F.element_at(F.array(*(F.lit(e).cast("long") for e in ends)), F.col("part") + 1)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order_by)) - 1
    write = uuid4().hex
    folder = f"{root}/data/{write}"
    dealt.withColumn("offset", first + place).write.partitionBy("part").parquet(folder)
    grown = spark.read.schema("offset LONG, part INT").parquet(folder).groupBy("part").agg((F.max("offset") + 1).alias("end"))
    later = list(ends)
    for r in grown.collect():
        later[r.part] = r.end
    version = next_version(spark, root)
    _put(spark, f"{root}/v={version}/commit.json", json.dumps({"write": write, "starts": ends, "ends": later}))
    _put(spark, f"{root}/v={version}/{DONE}", "")
    return version


def _put(spark: SparkSession, path: str, text: str) -> None:
    hpath, fs = fs_of(spark, path)
    out = fs.create(hpath, False)  # fails if it is there
    out.write(bytearray(text.encode()))
    out.close()


def _commit_of(uri: str, version: int) -> dict:
    files, path = _open(f"{uri}/v={version}/commit.json")
    with files.open_input_stream(path) as source:
        return json.loads(source.read())


def _versions(uri: str) -> list[int]:
    files, path = _open(uri)
    done = files.get_file_info([f"{i.path}/_SUCCESS" for i in files.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if "/v=" in i.path])
    return sorted(int(i.path.split("/v=")[1].split("/")[0]) for i in done if i.type == pafs.FileType.File)


@dataclass
class Piece(InputPartition):
    """Offsets [start, end) of a partition that one write holds."""

    folder: str
    partition: int
    start: int
    end: int


class _LogReader(DataSourceStreamReader):
    """Offsets are a list with the next offset of each partition.

    The engine asks for the latest offset without saying where it is, so the reader notes in
    ``progress`` what it has told, before it tells it: what a batch may end with is never behind it.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self._root, self._progress = options["path"], options["progress"]
        self._most = int(options.get("maxoffsetsperpartition", 10_000))
        self._starting = options.get("startingoffsets")
        self._told: list[int] | None = None

    def _ends(self) -> list[int]:
        found = _versions(self._root)
        return _commit_of(self._root, found[-1])["ends"] if found else []

    def initialOffset(self) -> dict:
        return {"next": json.loads(self._starting) if self._starting else [0] * len(self._ends())}

    def latestOffset(self) -> dict:
        ends = self._ends()
        told = self._told if self._told is not None else self._noted()
        if told is None:
            told = self.initialOffset()["next"]
        told = told + [0] * (len(ends) - len(told))
        self._told = [max(a, min(a + self._most, e)) for a, e in zip(told, ends)] if ends else told
        self._note()
        return {"next": self._told}

    def _noted(self) -> list[int] | None:
        files, path = _open(self._progress)
        if files.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as source:
            return json.loads(source.read())

    def _note(self) -> None:
        files, path = _open(self._progress)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(f"{path}.new") as out:
            out.write(json.dumps(self._told).encode())
        files.move(f"{path}.new", path)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after = end["next"]
        before = start["next"] + [0] * (len(after) - len(start["next"]))
        found, pieces = _versions(self._root), []
        # Ends only grow, so the writes that hold the offsets are next to each other.
        low, high = 0, len(found)
        while low < high:
            middle = (low + high) // 2
            if any(e > b for e, b in zip(_commit_of(self._root, found[middle])["ends"], before)):
                high = middle
            else:
                low = middle + 1
        for version in found[low:]:
            commit = _commit_of(self._root, version)
            for p, (a, e) in enumerate(zip(commit["starts"], commit["ends"])):
                a, e = max(a, before[p]), min(e, after[p])
                if a < e:
                    pieces.append(Piece(f"{self._root}/data/{commit['write']}/part={p}", p, a, e))
            if all(s >= x for s, x in zip(commit["starts"], after)):
                break
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, path = _open(partition.folder)
        names = [i.path for i in files.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".parquet")]
        offset = ds.field("offset")
        held = ds.dataset(names, filesystem=files, format="parquet")
        for batch in held.to_batches(columns=["offset", "key", "value", "timestamp"], filter=(offset >= partition.start) & (offset < partition.end)):
            time = batch.column("timestamp").cast(pa.timestamp("us", "UTC"))
            number = pa.array([partition.partition] * len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [number, *(batch.column(c) for c in ("offset", "key", "value")), time], ["partition", "offset", "key", "value", "timestamp"]
            )


class EventLog(DataSource):
    """``format("event_log")``: the log as a stream of records."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> _LogReader:
        return _LogReader({k.lower(): v for k, v in self.options.items()})


def log_records(spark: SparkSession, root: str, progress: str, most: int = 10_000, starting: Sequence[int] | None = None) -> DataFrame:
    """Stream of the records from ``starting`` (the next offset of each partition; by default all) on.

    A batch takes at most ``most`` records of a partition (twice as many after a run that ended
    between telling and noting a batch). ``progress`` is a file of this stream's own, to be kept
    with its checkpoint. Run it with a trigger interval: ``availableNow`` ends after one batch.
    """
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format(FORMAT).option("path", qualified(spark, root)).option("progress", qualified(spark, progress))
    reader = reader.option("maxOffsetsPerPartition", most)
    if starting is not None:
        reader = reader.option("startingOffsets", json.dumps(list(starting)))
    return reader.load()


def event_records(events: DataFrame) -> DataFrame:
    """Events as log records: JSON values, keyed by tenant and customer."""
    key = F.concat_ws("/", F.col("tenant_id"), F.col("customer_id"))
    return events.select(key.alias("key"), F.to_json(F.struct(*events.columns), {"timestampFormat": MICROS}).alias("value"), "timestamp")
