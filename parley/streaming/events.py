"""Ordered folds over a stream: the machines of the batch folds, fed in the order of event time.

Rows of a key wait in state until the watermark passes them and then go through the key's machine, sorted;
so the result does not depend on how rows are split into micro-batches or disordered within the watermark's
delay.  Rows that come later are dropped, and Spark counts them (``numRowsDroppedByWatermark``).  An
event-time timer closes a key that has been still for ``idle``: the machine gives its last rows and its state
goes; should the key come back, it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType

from parley.operators.folds import Machine

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(value, kind: DataType | None = None):
    """A value from pandas as state takes it."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, (list, tuple, dict)) or value is None:
        return value
    if pd.isna(value):
        return None
    if isinstance(value, np.generic):
        value = value.item()
    return int(value) if isinstance(kind, IntegralType) else value


class Keeper:
    """A machine whose whole state is one row."""

    def __init__(self, make: Callable[[], Machine]):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", self.make().STATE)

    def load(self) -> Machine:
        machine = self.make()
        if self.state.exists():
            machine.load(*self.state.get())
        return machine

    def save(self, machine: Machine) -> None:
        self.state.update(machine.save())

    def clear(self) -> None:
        self.state.clear()


class InOrder(StatefulProcessor):
    """Rows (us, *order columns, ...) of a key, through its machine once the watermark has passed them."""

    def __init__(self, keeper: Keeper, columns: list[str], kinds: list[DataType], waiting: str, order: int, names: list[str], idle_ms: int | None):
        self.keeper, self.columns, self.kinds, self.schema, self.order, self.names, self.idle = keeper, columns, kinds, waiting, order, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.clock = handle.getValueState("clock", "us long")
        self.keeper.init(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            values = [tuple(plain(v, k) for v, k in zip(r, self.kinds)) for r in frame[self.columns].itertuples(index=False, name=None)]
            if values:
                self.waiting.appendList(values)
                least = min(v[0] for v in values)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: r[: 1 + self.order])
        last = self.clock.get()[0] if self.clock.exists() else None
        out: list[tuple] = []
        if due:
            machine = self.keeper.load()
            for us, *values in due:
                if self.idle and last is not None and us - last >= self.idle * 1000:
                    out.extend(machine.end())
                    self.keeper.clear()
                    machine = self.keeper.load()
                out.extend(machine.row(*values))
                last = us
            self.keeper.save(machine)
            self.clock.update((last,))
            rest = [r for r in rows if r[0] > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self.handle.registerTimer(min(r[0] for r in rest) // 1000)
            if self.idle:
                self.handle.registerTimer(last // 1000 + self.idle)
        if self.idle and last is not None and now - last >= self.idle * 1000:
            out.extend(self.keeper.load().end())
            self.keeper.clear()
            self.clock.clear()
        yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)


def fold_events(rows: DataFrame, key: str, order: list[str], time: str, make: Callable[[], Machine], schema: str, idle_sec: float | None = None, keeper: type[Keeper] = Keeper) -> DataFrame:
    """A stream of (key, *output of the machine); ``rows`` has a watermark on its column ``time``.

    The machine is given the order columns, then the others but key and time, in the order of ``rows``.  Rows of one
    time go by the order columns.  Rows without a time are left out.  The session needs RocksDB as state store.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    others = [c for c in rows.columns if c not in (key, time, *order)]
    read = rows.where(F.col(time).isNotNull()).select(key, time, F.unix_micros(F.col(time).cast("timestamp")).alias("us__"), *order, *others)
    kinds = {f.name: f.dataType for f in read.schema.fields}
    columns = ["us__", *order, *others]
    waiting = ", ".join(f"c{i} {kinds[c].simpleString()}" for i, c in enumerate(columns))
    whole = f"`{key}` {kinds[key].simpleString()}, {schema}"
    names = spark.createDataFrame([], whole).columns
    processor = InOrder(keeper(make), columns, [kinds[c] for c in columns], waiting, len(order), names, None if idle_sec is None else int(idle_sec * 1000))
    return read.groupBy(key).transformWithStateInPandas(processor, whole, "append", "eventTime")


def fold_arrivals(rows: DataFrame, key: str, order: list[str], make: Callable[[], Machine], schema: str, idle_ms: int | None = None) -> DataFrame:
    """As ``fold_events`` for rows without event time: those of one micro-batch are sorted, earlier ones are never revised.

    The state of a key that is still for ``idle_ms`` of processing time is dropped.  For streams that run on: a run
    over what is available only never ends while such a clock runs.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    others = [c for c in rows.columns if c not in (key, *order)]
    whole = f"`{key}` {dict(rows.dtypes)[key]}, {schema}"
    names = rows.sparkSession.createDataFrame([], whole).columns
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def run(own, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine, out = make(), []
        if state.exists:
            machine.load(*state.get)
        for values in pd.concat(list(frames)).sort_values(order)[[*order, *others]].itertuples(index=False, name=None):
            out.extend((own[0], *r) for r in machine.row(*(plain(v, kinds[c]) for v, c in zip(values, [*order, *others]))))
        state.update(machine.save())
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.select(key, *order, *others).groupBy(key).applyInPandasWithState(run, whole, make().STATE, "append", timeout)
