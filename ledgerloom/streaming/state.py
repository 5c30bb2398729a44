"""Keyed state with event-time timers: what is remembered of a key, and when it is forgotten.

State lives in the RocksDB store of the executors, one small value per key, and is checkpointed with the stream, so a job that
is started again goes on where it stopped. A timer per key clears its value once the watermark has passed the time at which
the rules forget it anyway; so timers bound the state and never change a result. A row is late when its day is not after
the watermark, which is the newest day of all earlier batches less the allowed delay; late rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.streaming.jobs import run_available

DAY_MS = 86_400_000
#: Buckets that share out the keys of notifications where a batch holds many.
BUCKETS = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Start streams with the RocksDB store inside this block; the session's own setting comes back behind it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_stateful(stream: DataFrame, purpose: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """``run_available`` with the RocksDB store."""
    with rocksdb(stream.sparkSession):
        return run_available(stream, purpose, out, checkpoint)


def _instant(day: str) -> Column:
    return F.expr(f"timestamp_seconds(unix_date({day}) * 86400L)")


def _one_per_value(rows: DataFrame) -> DataFrame:
    """Rows without the repeats inside each Arrow batch, so a key that floods a stream is shuffled in few rows."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from table.group_by(table.column_names).aggregate([]).cast(table.schema).to_batches()

    return rows.mapInArrow(distinct, rows.schema)


class _Forgetful(StatefulProcessor):
    """A value per key and one timer, which is moved when the value is set."""

    def __init__(self, keys: StructType, value: str, keep_days: int):
        self.names, self.value, self.keep_days = keys.names, value, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("remembered", self.value)

    def remember(self, old: tuple | None, new: tuple) -> None:
        """Set the value; its last entry is the day it is kept from."""
        self.state.update(new)
        ends = (new[-1] + self.keep_days + 1) * DAY_MS
        if old is not None:
            before = (old[-1] + self.keep_days + 1) * DAY_MS
            if before == ends:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def in_time(self, rows: Iterator[Row], timer_values) -> list[Row]:
        """The rows of a key in this batch that are not late."""
        watermark = timer_values.getCurrentWatermarkInMs()
        return [r for r in rows if r.day_no * DAY_MS > watermark]

    def close(self) -> None:
        pass


class SilentAfter(_Forgetful):
    """Days on which a key is due: the first, and each that is more than ``keep_days`` after the last one given out."""

    def __init__(self, keys: StructType, keep_days: int):
        super().__init__(keys, "day int", keep_days)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        days = sorted({r.day_no for r in self.in_time(rows, timerValues)})
        old = self.state.get()
        due, last = [], None if old is None else old[-1]
        for day in days:
            if last is None or day - last > self.keep_days:
                due.append(day)
                last = day
        if due:
            self.remember(old, (last,))
        return iter([Row(*self.names, "day_no")(*key, day) for day in due])


class SilentBuckets(StatefulProcessor):
    """The same for all keys of a bucket, whose last days are one list: a batch costs a round trip or two per bucket, not per key. A bucket
    has one timer, at the first end of a silence in it.
    """

    def __init__(self, keys: StructType, keep_days: int):
        self.keys, self.names, self.keep_days = keys, keys.names, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("last_days", StructType([*self.keys, StructField("day", IntegerType())]))

    def _kept(self, watermark: int) -> dict[tuple, int]:
        """The last day of each key of the bucket that is silent still."""
        return {tuple(row[:-1]): row[-1] for row in self.state.get() if self._ends(row[-1]) > watermark}

    def _ends(self, day: int) -> int:
        return (day + self.keep_days + 1) * DAY_MS

    def _remember(self, last: dict[tuple, int]) -> None:
        if not last:
            self.state.clear()
            return
        self.state.put([(*key, day) for key, day in last.items()])
        ends = self._ends(min(last.values()))
        timers = list(self.handle.listTimers())
        for old in timers:
            if old != ends:
                self.handle.deleteTimer(old)
        if ends not in timers:
            self.handle.registerTimer(ends)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        days: dict[tuple, set[int]] = {}
        for r in rows:
            if r.day_no * DAY_MS > watermark:
                days.setdefault(tuple(r[k] for k in self.names), set()).add(r.day_no)
        last, due = self._kept(watermark), []
        for who, found in days.items():
            for day in sorted(found):
                if who not in last or day - last[who] > self.keep_days:
                    due.append((*who, day))
                    last[who] = day
        if due:
            self._remember(last)
        made = Row(*self.names, "day_no")
        return iter([made(*row) for row in due])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._remember(self._kept(timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def close(self) -> None:
        pass


class SlotChanges(_Forgetful):
    """Lines that say something new about a slot: other values than the newest line before, or the first after a silence."""

    def __init__(self, keys: StructType, values: StructType, keep_days: int):
        self.values = values.names
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values)
        super().__init__(keys, f"line_no bigint, {fields}, day int", keep_days)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = known = self.state.get()
        out = []
        for r in sorted(self.in_time(rows, timerValues), key=lambda r: r.line_no):
            line = (r.line_no, *(r[c] for c in self.values), r.day_no)
            silent = known is None or line[-1] - known[-1] > self.keep_days
            if not silent and line[0] <= known[0]:
                continue
            if silent or line[1:-1] != tuple(known[1:-1]):
                out.append(line)
            known = line
        if known is not old:
            self.remember(old, known)
        made = Row(*self.names, "line_no", *self.values, "day_no")
        return iter([made(*key, *line) for line in out])


def _stateful(
    rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: list[StructField], delay_days: int, groups: list[str] | None = None
) -> DataFrame:
    clocked = rows.where("day_no IS NOT NULL").withColumn("_at", _instant("date_from_unix_date(day_no)")).withWatermark("_at", f"{delay_days} days")
    schema = StructType([*(rows.schema[k] for k in keys), *out, StructField("day_no", IntegerType())])
    found = clocked.groupBy(*(groups or keys)).transformWithState(processor, schema, "Append", "EventTime")
    return found.withColumn("day", F.expr("date_from_unix_date(day_no)")).drop("day_no")


def due_notifications(
    events: DataFrame, keys: list[str], day: str = "day", keep_days: int = 120, delay_days: int = 1, buckets: int | None = None
) -> DataFrame:
    """(keys, day) of the notifications that are due: a key is silent for ``keep_days`` days from its last one.

    ``events`` is a stream with a date column. Days of a key are judged in order within a batch, batch after batch. State is
    kept by key; with ``buckets`` the keys of a bucket are worked together, which is faster where a batch holds many keys. Their
    number holds for the life of a checkpoint.
    """
    days = _one_per_value(events.select(*keys, F.unix_date(day).alias("day_no")))
    schema = StructType([days.schema[k] for k in keys])
    if not buckets:
        return _stateful(days, keys, SilentAfter(schema, keep_days), [], delay_days)
    days = days.withColumn("bucket_no", F.expr(f"cast(pmod(xxhash64({', '.join(f'`{k}`' for k in keys)}), {buckets}) AS int)"))
    return _stateful(days, keys, SilentBuckets(schema, keep_days), [], delay_days, ["bucket_no"])


def slot_changes(
    log: DataFrame, keys: list[str], values: list[str], line_no: str = "line_no", day: str = "day", keep_days: int = 30, delay_days: int = 1
) -> DataFrame:
    """(keys, line_no, values, day) of the lines that change what is known of their slot; newer lines win.

    ``log`` is a stream with a line number that rises with time. A slot without a line for more than ``keep_days`` days is
    forgotten, so its next line is a change whatever it says. The lines of one slot in one micro-batch are sorted in memory;
    the stream's own limits (files or rows per trigger) bound them.
    """
    lines = log.select(*keys, F.col(line_no).cast("long").alias("line_no"), *values, F.unix_date(day).alias("day_no"))
    of = lambda names: StructType([lines.schema[n] for n in names])
    return _stateful(lines, keys, SlotChanges(of(keys), of(values), keep_days), [lines.schema["line_no"], *of(values)], delay_days)
