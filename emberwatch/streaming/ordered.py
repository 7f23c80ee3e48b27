"""Keyed stream state that sees the rows of a key in event-time order, each row once.

Rows wait in slots of event time, one list per slot, until the watermark passes the slot's end; then they
are stepped through in (us, seq, ord) order. So arrival order does not matter as long as rows come within the
allowed delay, a slot is read once, and rows that are not due are not touched. Later rows are dropped by the
watermark; ``LateRows`` counts them. State is typed and lives in RocksDB. A key that has been silent for its
time to live is forgotten by an event-time timer (state with its own time to live needs processing time).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

SECOND = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OrderedProcessor(StatefulProcessor):
    """Subclasses give the columns of their rows and outputs, keep typed state and make one step per row.

    ``load`` reads what ``step(row)`` needs, ``step`` returns an output tuple or None, ``save`` writes what has
    changed; both are called once per key and trigger. ``forget`` clears the state of a key silent for ``ttl_us``.
    """

    row_schema = ""
    fields: tuple[str, ...] = ()
    ttl_us: int | None = None
    slot_us = SECOND

    def keep(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> None:
        raise NotImplementedError

    def step(self, row: dict):
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [p.split()[0] for p in self.row_schema.split(", ")]
        self.waiting = handle.getMapState("waiting", "slot bigint", f"rows array<struct<{self.row_schema.replace(' ', ':').replace(',:', ',')}>>")
        self.last = handle.getValueState("last", "us bigint")
        self.keep(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, list] = {}
        for pdf in rows:
            for row in pdf[self.names].itertuples(index=False, name=None):
                slots.setdefault(row[0] // self.slot_us, []).append(row)
        for slot, new in slots.items():
            known = self.waiting.getValue((slot,))
            self.waiting.updateValue((slot,), ([*map(tuple, known[0]), *new] if known else new,))
            self.handle.registerTimer((slot + 1) * self.slot_us // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(s for (s,) in self.waiting.keys() if (s + 1) * self.slot_us <= upto)
        if not due:  # done by an earlier timer of this trigger, or the key has been silent
            last = self.last.get() if self.ttl_us else None
            if last and upto >= last[0] + self.ttl_us and not self.waiting.exists():
                self.last.clear()
                self.forget()
            return
        self.load()
        out, us = [], 0
        for slot in due:
            for row in sorted((dict(zip(self.names, r)) for r in self.waiting.getValue((slot,))[0]), key=lambda r: (r["us"], r["seq"], r.get("ord", 0))):
                us = row["us"]
                made = self.step(row)
                if made is not None:
                    out.append((key[0], us, row["seq"], *made))
            self.waiting.removeKey((slot,))
        self.save()
        if self.ttl_us:
            self.last.update((us,))
            self.handle.registerTimer((us + self.ttl_us) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["k", "us", "seq", *self.fields])

    def close(self) -> None:
        pass


def watched(rows: DataFrame, delay: str, wanted: Column) -> DataFrame:
    """The ``wanted`` rows, with a watermark that all rows move.

    The optimizer moves filters below a watermark unless they look at its column. Below it, what a detector does
    not want would not move its watermark, and its last rows would wait for others of their kind.
    """
    return rows.withWatermark("ts", delay).where(F.when(F.col("ts").isNotNull(), wanted))


def run_ordered(rows: DataFrame, processor: OrderedProcessor, schema: str) -> DataFrame:
    """rows: (k, ts, seq, ...) stream with a watermark on ts; schema: the processor's output after k, us and seq."""
    keyed = rows.withColumn("us", F.unix_micros("ts"))
    return keyed.groupBy("k").transformWithStateInPandas(
        processor, f"k string, us bigint, seq bigint, {schema}", "Append", "EventTime")


class LateRows(StreamingQueryListener):
    """Counts, per query name or id, the rows that came later than the allowed delay and were dropped.

    Add it with ``spark.streams.addListener``; ``dropped`` maps a query to its count so far.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        name = progress.name or str(progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + late

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
