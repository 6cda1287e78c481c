"""The live job: restarts, late bars, warm-up."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from alphaloom.streaming import live

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def bars(spark, rows):
    return spark.createDataFrame([("b", k, at, v) for k, at, v in rows], "book string, key string, at timestamp, value double").coalesce(1)


def some_rows(days=range(0, 100)):
    rng = np.random.default_rng(1)
    steps = rng.normal(size=(6, 100)).cumsum(axis=1)
    return [(f"k{k}", START + d * DAY + dt.timedelta(hours=k), float(steps[k, d])) for d in days for k in range(6) if (d + k) % 7]


def stream(spark, path):
    return spark.readStream.schema("book string, key string, at timestamp, value double").parquet(path)


def brute(rows, size, top, dates):
    held, out = {}, []
    for at in dates:
        ring = {k: [v for _, v in sorted((t, v) for key, t, v in rows if key == k and t < at)][-size:] for k in {r[0] for r in rows}}
        ring = {k: np.array(v) for k, v in sorted(ring.items()) if len(v) == size}
        if not ring:
            continue
        m, s = np.array([v[-1] - v[0] for v in ring.values()]), np.array([np.diff(v).std() for v in ring.values()])
        score = np.round((m - m.mean()) / m.std() - (s - s.mean()) / s.std(), 9)
        best = [k for _, k in sorted(zip(-score, ring, strict=True))][:top]
        out += [(at, k, 1 / top if k in best else 0.0, held.get(k, 0.0)) for k in sorted({*best, *held})]
        held = dict.fromkeys(best, 1 / top)
    return out


def placed(spark, path):
    return [(r["at"], r["key"], r["weight"], r["held"]) for r in live.read_batches(spark, path, live.ORDERS).orderBy("at", "key").collect()]


MONTHS = [dt.datetime(2024, m, 1) for m in (2, 3, 4)]


def test_restart_gives_the_same_orders(spark, tmp_path):
    rows, src = some_rows(), str(tmp_path / "in")
    want = brute(rows, 10, 2, MONTHS)
    assert len(want) > 6 and any(w == 0 for *_, w, _ in want)
    for part in (range(0, 25), range(25, 70), range(70, 100)):  # each part ends the job and starts it again
        mine = [r for r in rows if (r[1] - START).days in part]
        bars(spark, mine[::-1]).write.mode("append").parquet(src)
        live.start_job(live.orders(stream(spark, src), 10, 2, "month"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert placed(spark, str(tmp_path / "out")) == want


def test_a_batch_that_runs_twice_writes_once(spark, tmp_path):
    write, path = live.write_batches(str(tmp_path / "out")), str(tmp_path / "out")
    batch = spark.createDataFrame([("b", START, "k", 1.0, 0.0, 2.0)], live.ORDERS)
    for number in (0, 1, 1):
        write(batch, number)
    assert live.read_batches(spark, path, live.ORDERS).count() == 2


def test_late_bars_and_missing_values(spark, tmp_path):
    src, rows = str(tmp_path / "in"), some_rows(range(0, 40))
    bars(spark, rows).write.mode("append").parquet(src)
    job = lambda: live.start_job(live.snapshots(stream(spark, src), 10, "month"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    job()
    # behind the watermark: dropped; a null value: skipped; in time: taken
    more = [("k1", START + 20 * DAY, 1e9), ("k1", START + 41 * DAY, None), ("k1", START + 61 * DAY, 5.0)]
    bars(spark, more).write.mode("append").parquet(src)
    job()
    out = {(r["key"], r["at"]): r["momentum"] for r in live.read_batches(spark, str(tmp_path / "out"), live.FEATURES).collect()}
    ring = [v for k, t, v in rows if k == "k1"][-10:]
    assert out["k1", MONTHS[1]] == ring[-1] - ring[0] and max(abs(v) for v in out.values()) < 1e6


def test_warm_start_equals_a_long_stream(spark, tmp_path):
    rows, begin = some_rows(), START + 45 * DAY
    past = bars(spark, [r for r in rows if r[1] <= begin])
    for name, mine, more in (("all", rows, {}), ("warm", [r for r in rows if r[1] > begin], {"history": past, "begin": begin})):
        bars(spark, mine).write.parquet(str(tmp_path / f"in-{name}"))
        live.start_job(live.snapshots(stream(spark, str(tmp_path / f"in-{name}")), 30, "month", **more), str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}")).awaitTermination()
    both = [live.read_batches(spark, str(tmp_path / f"out-{n}"), live.FEATURES).filter(F.col("at") > begin).orderBy("at", "key").collect() for n in ("all", "warm")]
    assert both[0] == both[1] and len(both[0]) > 6
    # begin keeps earlier dates silent
    assert live.read_batches(spark, str(tmp_path / "out-warm"), live.FEATURES).filter(F.col("at") <= begin).count() == 0


def test_dates_of_the_schedule():
    at = lambda *a: (dt.datetime(*a) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert live.next_date(at(2024, 12, 31, 5), "month") == at(2025, 1, 1) and live.next_date(at(2024, 2, 1), "month") == at(2024, 3, 1)
    assert live.next_date(at(2024, 1, 1), "week") == at(2024, 1, 8) and live.next_date(at(2024, 1, 7, 23), "week") == at(2024, 1, 8)
    assert live.next_date(at(1969, 12, 31, 1), "day") == at(1970, 1, 1)


def test_ring_takes_the_rows_of_a_batch_in_any_order():
    from alphaloom.streaming import bars

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    frame = lambda *rows: pd.DataFrame([(pd.Timestamp(2024, 1, d), v) for d, v in rows], columns=["at", "value"])
    state, step = State(), bars.ring(3)
    run = lambda *frames: [(r.at_.day, r.momentum) for d in step(("k",), iter(frames), state) for r in d.rename(columns={"at": "at_"}).itertuples()]
    assert run(frame((5, 5.0), (4, 4.0)), frame((1, 1.0), (3, 9.0), (5, 2.0), (5, None)), frame((2, 2.0))) == [(5, -7.0)]
    assert run(frame((5, 1.0), (7, 7.0)), frame((6, 6.0))) == [(7, 5.0)]  # the fifth was sent


def test_ring_reads_and_writes_a_symbol_once():
    class Handle:
        value, calls, timers = None, [], []

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return pd.Timestamp(2024, 1, 16).value // 1_000_000

    h, ring = Handle(), live.Ring(2, "week")
    frame = lambda *days: pd.DataFrame({"book": "b", "at": [pd.Timestamp(2024, 1, d) for d in days], "value": [float(d) for d in days]})
    ring.init(h)
    assert list(ring.handleInputRows(("k",), iter([frame(3, 2), frame(10, 16)]), h)) == [] and h.calls == ["update"]
    assert list(ring.handleInputRows(("k",), iter([frame(9)]), h)) == [] and h.calls == ["update", "get", "update"]
    out = pd.concat(ring.handleExpiredTimer(("k",), h, None))
    assert list(zip(out["at"].dt.day, out["momentum"], strict=True)) == [(8, 1.0), (15, 1.0)] and len(h.calls) == 5
    assert h.value[2:] == ([pd.Timestamp(2024, 1, d).value // 1000 for d in (10, 16)], [10.0, 16.0])
