"""Structured Streaming: idempotent table sinks, a change-feed source, stateful working memory, sensors."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from lodevec.sources.files import place
from lodevec.sources.table import Table


def table_sink(stream: DataFrame, table: Table, name: str, checkpoint: str, trigger: dict | None = None, required: Sequence[str] = (), max_rows: int | None = None) -> DataStreamWriter:
    """A writer that appends every micro-batch to ``table`` once, also after a restart: the batch's id is the stream's name and epoch.

    Rows in which a ``required`` column is null stop the stream.  By default a batch is made every 30 seconds.
    ``max_rows`` splits a batch into several appends, each with an id of its own.
    """
    spark, root = stream.sparkSession, table.root

    def append(batch: DataFrame, epoch: int) -> None:
        t = Table.open(spark, root)
        for c in required:
            if batch.where(batch[c].isNull()).limit(1).count():
                raise ValueError(f"{name}: null in required column {c}")
        if not max_rows:
            t.append(batch, batch_id=f"{name}/{epoch}")
            return
        n = max(1, -(-batch.count() // max_rows))
        # by a hash of the row, so that a batch that comes again after a failure is divided the same way
        part = F.pmod(F.xxhash64(*[F.to_json(F.struct(c)) for c in batch.columns]), F.lit(n))
        for i in range(n):
            t.append(batch.where(part == i) if n > 1 else batch, batch_id=f"{name}/{epoch}/{i}")

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).foreachBatch(append)


class MicroBatchBuffer:
    """Rows gathered on the driver until 64 MiB, 100,000 rows or 30 seconds (looked at on each call), then appended as one batch.

    A failed append keeps the rows.
    """

    def __init__(self, table: Table, max_bytes: int = 64 << 20, max_rows: int = 100_000, max_seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.table, self.max_bytes, self.max_rows, self.max_seconds, self.clock = table, max_bytes, max_rows, max_seconds, clock
        self.rows: list[tuple] = []
        self.bytes, self.since = 0, clock()

    def insert(self, rows: Sequence[tuple]) -> int | None:
        self.rows += [tuple(r) for r in rows]
        self.bytes += sum(len(json.dumps(r, default=str)) for r in rows)
        return self.flush_if_due()

    def due(self) -> bool:
        return bool(self.rows) and (self.bytes >= self.max_bytes or len(self.rows) >= self.max_rows or self.clock() - self.since >= self.max_seconds)

    def flush_if_due(self) -> int | None:
        return self.flush() if self.due() else None

    def flush(self) -> int | None:
        if not self.rows:
            return None
        done = self.table.append(self.table.spark.createDataFrame(self.rows, self.table.schema()))
        self.rows, self.bytes, self.since = [], 0, self.clock()
        return done


def deliver(messages: Iterable[dict], tables: dict[str, Table], **limits) -> Iterator[dict]:
    """Write the records of several streams, each to its table; a state message is passed on only when all rows before it are committed.

    Messages: ``{"type": "RECORD", "stream": name, "data": {column: value}}`` and ``{"type": "STATE", ...}``.  Records of other streams are left out; missing
    columns are null.  What is left at the end is committed, too.
    """
    buffers = {name: MicroBatchBuffer(t, **limits) for name, t in tables.items()}
    columns = {name: [f.name for f in t.schema().fields] for name, t in tables.items()}
    for m in messages:
        if m["type"] == "RECORD" and m["stream"] in buffers:
            buffers[m["stream"]].insert([tuple(m["data"].get(c) for c in columns[m["stream"]])])
        elif m["type"] == "STATE":
            for b in buffers.values():
                b.flush()
            yield m
    for b in buffers.values():
        b.flush()


class _LastRows(StatefulProcessor):
    def __init__(self, n: int, columns: list[str], order: str, schema: str):
        self.n, self.columns, self.order, self.schema = n, columns, order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.state.get()) if self.state.exists() else []
        old = pd.DataFrame(kept, columns=self.columns)
        new = pd.concat([old, *[r[self.columns] for r in rows]]) if len(old) else pd.concat([r[self.columns] for r in rows])
        new = new.sort_values(self.order, kind="stable").tail(self.n)
        self.state.put([tuple(r) for r in new.itertuples(index=False)])
        yield new

    def close(self) -> None:
        pass


def stream_working_memory(stream: DataFrame, n: int, owner: str, order: str) -> DataFrame:
    """For each micro-batch, the last ``n`` rows of every owner it touched; older ones are evicted from the state."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    processor = _LastRows(n, stream.columns, order, schema)
    return stream.groupBy(owner).transformWithStateInPandas(processor, outputStructType=stream.schema, outputMode="Update", timeMode="None")


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class SnapshotLogReader(DataSourceStreamReader):
    """Offsets are sequence numbers; the rows of a batch are the snapshots committed since."""

    def __init__(self, root: str):
        self.root = root

    def _snapshots(self) -> list[dict]:
        from pyarrow import fs

        files, folder = place(f"{self.root}/_log")
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("v") and f.base_name.endswith(".json"))
        with files.open_input_stream(names[-1]) as f:
            return json.loads(f.read())["snapshots"]

    def initialOffset(self) -> dict:
        return {"sequence": 0}

    def latestOffset(self) -> dict:
        return {"sequence": max((s["sequence"] for s in self._snapshots()), default=0)}

    def partitions(self, start: dict, end: dict):
        return [_Range(start["sequence"], end["sequence"])]

    def read(self, partition: _Range):
        for s in self._snapshots():
            if partition.start < s["sequence"] <= partition.end:
                yield (s["id"], s["parent"], s["sequence"], s["operation"])


class SnapshotSource(DataSource):
    """``spark.readStream.format("lodevec_snapshots").option("root", …)``: the snapshots of a table as they come, for change-feed cursors."""

    @classmethod
    def name(cls) -> str:
        return "lodevec_snapshots"

    def schema(self) -> str:
        return "snapshot_id long, parent_id long, sequence_number long, operation string"

    def streamReader(self, schema) -> SnapshotLogReader:
        return SnapshotLogReader(self.options["root"])


def follow_changes(spark: SparkSession, table: Table, handle: Callable[[DataFrame, int], None], checkpoint: str, key: Sequence[str] = ()) -> DataStreamWriter:
    """Call ``handle(changes, sequence)`` for the net changes of the snapshots of each micro-batch; the cursor is the stream's checkpoint."""
    spark.dataSource.register(SnapshotSource)
    snapshots = spark.readStream.format("lodevec_snapshots").option("root", table.root).load()
    root = table.root

    def step(batch: DataFrame, epoch: int) -> None:
        rows = sorted(batch.collect(), key=lambda r: r["sequence_number"])  # one row for each commit
        if not rows:
            return
        t = Table.open(spark, root)
        first, last = rows[0], rows[-1]
        if first["parent_id"] is None:
            start = t.scan(first["snapshot_id"])
            handle(start.withColumn("_change_type", F.lit("insert")), first["sequence_number"])
            if len(rows) == 1:
                return
            begin = first["snapshot_id"]
        else:
            begin = first["parent_id"]
        handle(t.read_changes(begin, last["snapshot_id"], key), last["sequence_number"])

    return snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def wait_for(check: Callable[[], bool], timeout: float = 60.0, interval: float = 1.0) -> bool:
    """Poll until ``check`` holds; whether it came to hold in time."""
    end = time.monotonic() + timeout
    while True:
        if check():
            return True
        if time.monotonic() >= end:
            return False
        time.sleep(interval)


def wait_for_snapshot(table: Table, after: int | None = None, timeout: float = 60.0, interval: float = 1.0) -> bool:
    """Until the table has a snapshot newer than sequence number ``after``."""
    return wait_for(lambda: table.meta["sequence"] > (after or 0), timeout, interval)


def wait_for_index(table: Table, timeout: float = 60.0, interval: float = 1.0) -> bool:
    """Until no file of the table waits for its geometry."""
    return wait_for(lambda: table.info().first()["indexing"] == 0, timeout, interval)
