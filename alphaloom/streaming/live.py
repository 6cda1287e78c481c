"""The live job: bars arrive, every symbol keeps a ring of its last ones, on a schedule the book is ranked and orders go out.

Two stateful operators, both in the state store, so that a restart goes on where the last finished batch ended:

* ``Ring`` (a group per symbol): its bars, of which the last ``size`` before the next date of the schedule and all later ones are
  held. An event-time timer at that date reports the symbol's features. Its state can start from a batch of history (warm-up),
  and dates up to ``begin`` stay silent.
* ``Book`` (a group per book): the symbols' features of one date, ranked when event time has passed it; holdings are state, and the
  difference between them and the new targets leaves as orders.

Late data: a bar may come out of order until the watermark has passed it; a bar behind the watermark is dropped by Spark, as a bar that is
late cannot change orders that were sent. Bars without a value are skipped. A symbol with fewer than ``size`` bars before a date has no
features on it, and a date without any symbol that has them leaves the book as it is.
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

#: The state store that lists, maps and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

FEATURES = "book string, key string, at timestamp, momentum double, volatility double"
ORDERS = "book string, at timestamp, key string, weight double, held double, score double"


def next_date(micros: int, period: str) -> int:
    """The first date of the schedule after a time, both in microseconds: midnights, Mondays or firsts of months, UTC."""
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(micros))).date()
    if period == "month":
        after = dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)
    else:
        after = day + dt.timedelta(days=1 if period == "day" else 7 - day.weekday())
    return (after - dt.date(1970, 1, 1)).days * 86_400_000_000


def features(values: np.ndarray) -> tuple[float, float]:
    """Change over the ring and population deviation of its steps."""
    return float(values[-1] - values[0]), float(np.diff(values).std())


class Ring(StatefulProcessor):
    """Bars (key, book, at, value) in, features of every date of the schedule out."""

    def __init__(self, size: int, period: str, begin: int = 0):
        self.size, self.period, self.begin = size, period, begin

    def init(self, handle) -> None:
        self.handle = handle
        # one value, so that a symbol costs a read and a write, however many bars it has
        self.held = handle.getValueState("held", "next long, book string, ats array<long>, vals array<double>")

    def _take(self, rows: Iterator[pd.DataFrame]) -> None:
        new, book = [], None
        for pdf in rows:
            pdf = pdf[pdf["value"].notna() & pdf["at"].notna()]
            if len(pdf):
                book = str(pdf["book"].iloc[0]) if book is None else book
                new += zip(pdf["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), pdf["value"].to_numpy(dtype=float).tolist(), strict=True)
        if not new:
            return
        held = self.held.get() if self.held.exists() else None
        if held is None:
            self._wait(next_date(max(min(new)[0], self.begin), self.period), book, new)
        else:
            at, book, ats, values = held
            self.held.update((at, book, [*ats, *(t for t, _ in new)], [*values, *(v for _, v in new)]))

    def _wait(self, at: int, book: str, bars: list[tuple[int, float]]) -> None:
        self.held.update((at, book, [t for t, _ in bars], [v for _, v in bars]))
        self.handle.registerTimer(at // 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take(iter([initialState]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._take(rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, book, ats, values = self.held.get()
        bars, passed, out = sorted(zip(ats, values, strict=True)), timerValues.getCurrentWatermarkInMs() * 1000, []
        while at <= passed:  # a symbol that was still for long catches up at once
            before = bisect.bisect_left(bars, (at,))
            ring = [v for _, v in bars[max(before - self.size, 0) : before]]
            if len(ring) == self.size:
                out.append((book, str(key[0]), pd.Timestamp(at, unit="us"), *features(np.array(ring))))
            at = next_date(at, self.period)
        self._wait(at, book, bars[max(bisect.bisect_left(bars, (at,)) - self.size, 0) :])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])


def z_score(x: np.ndarray) -> np.ndarray:
    """Population z-score; without spread or with one value, zeros."""
    return (x - x.mean()) / x.std() if len(x) > 1 and x.std() > 0 else np.zeros(len(x))


def rank_book(keys: list[str], momentum: np.ndarray, volatility: np.ndarray, top: int) -> dict[str, float]:
    """The ``top`` keys by score and their scores; ties by key."""
    score = np.round(z_score(momentum) - z_score(volatility), 9)
    return {keys[i]: float(score[i]) for i in sorted(range(len(keys)), key=lambda i: (-score[i], keys[i]))[:top]}


class Book(StatefulProcessor):
    """Features in, orders out: equal weights for the best symbols, zero for what is dropped."""

    def __init__(self, top: int):
        self.top = top

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, key string, momentum double, volatility double")
        self.holdings = handle.getMapState("holdings", "key string", "weight double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            new += zip(pdf["at"].astype("datetime64[us]").astype("int64").tolist(), pdf["key"].tolist(), pdf["momentum"].tolist(), pdf["volatility"].tolist(), strict=True)
        self.waiting.appendList(new)
        for at in sorted({r[0] for r in new}):
            self.handle.registerTimer(at // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, rows = expiredTimerInfo.getExpiryTimeInMs() * 1000, sorted(self.waiting.get())
        now = [r for r in rows if r[0] == due]
        left = [r for r in rows if r[0] > due]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if not now:
            return
        chosen = rank_book([r[1] for r in now], np.array([r[2] for r in now]), np.array([r[3] for r in now]), self.top)
        held = {k[0]: v[0] for k, v in self.holdings.iterator()} if self.holdings.exists() else {}
        weight, out = 1.0 / len(chosen), []
        for name in sorted(set(chosen) | set(held)):
            out.append((str(key[0]), pd.Timestamp(due, unit="us"), name, weight if name in chosen else 0.0, held.get(name, 0.0), chosen.get(name)))
            if name in chosen:
                self.holdings.updateValue((name,), (weight,))
            else:
                self.holdings.removeKey((name,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ORDERS.split(", ")])


def snapshots(bars: DataFrame, size: int, period: str = "month", late: str = "1 hour", history: DataFrame | None = None, begin: dt.datetime | None = None) -> DataFrame:
    """FEATURES of every symbol and date of the schedule after ``begin`` (UTC); bars up to there only fill the rings.

    ``bars``: a stream (book, key, at, value); ``history``: a batch of the same that the state starts from.
    """
    micros = (begin - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) if begin else 0
    take = lambda d: d.select(*(F.col(c).cast(t).alias(c) for c, t in (("book", "string"), ("key", "string"), ("at", "timestamp"), ("value", "double"))))
    start = take(history).groupBy("key") if history is not None else None
    return take(bars).withWatermark("at", late).groupBy("key").transformWithStateInPandas(Ring(size, period, micros), FEATURES, "Append", "EventTime", start, eventTimeColumnName="at")


def orders(bars: DataFrame, size: int, top: int, period: str = "month", late: str = "1 hour", history: DataFrame | None = None, begin: dt.datetime | None = None) -> DataFrame:
    """ORDERS of every book: what each rebalance of the schedule buys, keeps and sells."""
    return snapshots(bars, size, period, late, history, begin).groupBy("book").transformWithStateInPandas(Book(top), ORDERS, "Append", "EventTime", eventTimeColumnName="at")


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a folder per batch, overwritten where a batch runs again, so every row arrives exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return write


def start_job(out: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a job that writes ``out`` below ``path``; a job started again with the same ``checkpoint`` goes on."""
    spark: SparkSession = out.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # a query takes the settings of the session when it starts
    try:
        return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_batches(path)).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that a job has written."""
    return spark.read.schema(schema).parquet(path).select(*(c.split()[0] for c in schema.split(", ")))
