"""Incremental processing: keyed ring buffers of the last values, windowed order flow with late data, monthly rebalancing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, at timestamp, n int, momentum double, volatility double"


def ring(size: int) -> Callable:
    """A stateful function that keeps the last ``size`` values of a key and reports once the buffer is full.

    Events older than the newest of an earlier micro-batch are dropped, as a bar that is late cannot change a signal that was sent.
    The rows of one micro-batch come in any order, a key's in several frames; the least of several values at one time counts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        sent = max(held, default=None)
        for pdf in batches:
            pdf = pdf[pdf["value"].notna() & pdf["at"].notna()]
            for at, value in zip(pdf["at"].astype("datetime64[ns]").astype("int64").tolist(), pdf["value"].astype(float).tolist(), strict=True):
                if sent is None or at > sent:
                    held[at] = min(value, held.get(at, value))
            held = {at: held[at] for at in sorted(held)[-size:]}  # no older time can come back into the last ones
        times, values = list(held), list(held.values())
        state.update((times, values))
        if len(values) == size:
            v = pd.Series(values)
            yield pd.DataFrame({"key": [str(key[0])], "at": [pd.Timestamp(times[-1])], "n": [size], "momentum": [v.iloc[-1] - v.iloc[0]], "volatility": [v.diff().std()]})

    return step


def ring_features(stream: DataFrame, size: int = 282) -> DataFrame:
    """``stream``: (key, at, value), batch or streaming source; one row per key and micro-batch with a full buffer."""
    return stream.groupBy("key").applyInPandasWithState(ring(size), OUT, "times array<long>, vals array<double>", "append", "NoTimeout")


def order_flow(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, buys, sells) per event-time window; events later than ``late`` are dropped."""
    n = lambda *kinds: F.sum(F.col("event_type").isin(*kinds).cast("int"))
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(n("purchase", "signup").alias("buys"), n("click", "error").alias("sells"))
    return g.select(F.col("window.start").alias("start"), "key", "buys", "sells")


def monthly(target: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls ``target(batch, month)`` whenever a batch reaches a new month."""
    seen: list[str] = []

    def run(batch: DataFrame, _: int) -> None:
        month = batch.agg(F.date_format(F.max("at"), "yyyy-MM")).first()[0]
        if month and (not seen or month > seen[-1]):
            seen.append(month)
            target(batch, month)

    return run


def equal_weights(signals: DataFrame, held: DataFrame, top: int) -> DataFrame:
    """(key, weight): equal weights of the top names, 0 for names held before that are dropped."""
    from alphaloom.operators.ranking import top_n

    chosen = top_n(signals.withColumn("_k", F.lit(0)), top, "score", "_k", tie="key").select("key", F.lit(1.0 / top).alias("weight"))
    return chosen.unionByName(held.select("key").join(chosen, "key", "left_anti").withColumn("weight", F.lit(0.0)))
