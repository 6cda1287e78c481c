"""Streaming queries: the events table replayed through Structured Streaming into a table in the shared folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from alphaloom.registry import query
from alphaloom.session import scratch_root
from alphaloom.sql import sql
from alphaloom.streaming import bars, live


def _replayed(spark, sf_dir, transform, mode="append"):
    """Run ``transform`` over the stream of events until all input is read; returns the table that it wrote."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    at = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    out = transform(events)
    out.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("x01_ring_features", sql('key "at" n ~momentum ~volatility', """FROM (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS "at", CAST(5 AS INT) AS n, arg_max(value, ts) - arg_min(value, ts) AS momentum, stddev_samp(step) AS volatility FROM
 (SELECT *, CASE WHEN back < 5 THEN value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) END AS step FROM (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM
 (SELECT user_id, ts, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2))) WHERE back <= 5 GROUP BY 1 HAVING count(*) = 5)"""))
def x01(spark, sf_dir):
    return _replayed(spark, sf_dir, lambda e: bars.ring_features(e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), "value"), 5))


@query("x02_windowed_flow", sql("start key #buys #sells", """FROM (SELECT date_trunc('day', ts) AS start, 'S' || (user_id % 10) AS key, sum(CAST(event_type IN ('purchase', 'signup') AS INT)) AS buys, sum(CAST(event_type IN ('click', 'error') AS INT)) AS sells
 FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2)"""))
def x02(spark, sf_dir):
    return _replayed(spark, sf_dir, lambda e: bars.order_flow(e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.concat(F.lit("S"), F.col("user_id") % 10).alias("key"))))


def event_stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def event_bars(events):
    """(book, key, at, value): each event is a bar of its user; three books share the users."""
    return events.select(F.concat(F.lit("B"), F.col("user_id") % 3).alias("book"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), "value")


def _lived(spark, out, schema):
    at = f"{scratch_root(spark)}/live-{uuid.uuid4().hex}"
    live.start_job(out, f"{at}/out", f"{at}/state").awaitTermination()
    return live.read_batches(spark, f"{at}/out", schema)


RING, TOP, BEGIN = 8, 5, dt.datetime(2024, 1, 10)
#: Rings of every user at every Monday that event time has passed, less an hour for late bars.
_SNAPSHOTS = """monday AS (SELECT unnest(generate_series(date_trunc('week', min(ts)) + INTERVAL 7 DAY, max(ts) - INTERVAL 1 HOUR, INTERVAL 7 DAY)) AS "at" FROM events),
back AS (SELECT "at", 'B' || (user_id % 3) AS book, CAST(user_id AS VARCHAR) AS key, ts, value, row_number() OVER (PARTITION BY "at", user_id ORDER BY ts DESC, value DESC) AS b FROM monday JOIN events ON ts < "at" WHERE value IS NOT NULL QUALIFY b <= 8),
ring AS (SELECT "at", book, key, max(value) FILTER (b = 1) - max(value) FILTER (b = 8) AS momentum, stddev_pop(step) AS volatility FROM
 (SELECT *, value - lag(value) OVER (PARTITION BY "at", key ORDER BY b DESC) AS step FROM back) GROUP BY ALL HAVING count(*) = 8)"""
_Z = lambda x: f"CASE WHEN stddev_pop({x}) OVER w > 0 THEN ({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w ELSE 0 END"


@query("x02_live_orders", f"""WITH {_SNAPSHOTS},
scored AS (SELECT "at", book, key, round({_Z("momentum")} - {_Z("volatility")}, 9) AS score FROM ring WINDOW w AS (PARTITION BY "at", book)),
chosen AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY "at", book) AS weight FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY "at", book ORDER BY score DESC, key) <= {TOP})),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY book ORDER BY "at") AS n FROM chosen),
date AS (SELECT DISTINCT book, "at", n FROM numbered)
SELECT d.book, d."at", coalesce(a.key, p.key) AS key, round(CAST(coalesce(a.weight, 0) AS DOUBLE), 6) AS weight, round(CAST(coalesce(p.weight, 0) AS DOUBLE), 6) AS held, round(a.score, 6) AS score FROM
 (SELECT book, n, key FROM numbered UNION SELECT t.book, t.n + 1, key FROM numbered t JOIN date d ON d.book = t.book AND d.n = t.n + 1) k JOIN date d ON d.book = k.book AND d.n = k.n
 LEFT JOIN numbered a ON a.book = k.book AND a.n = k.n AND a.key = k.key LEFT JOIN numbered p ON p.book = k.book AND p.n = k.n - 1 AND p.key = k.key""")
def x02_live(spark, sf_dir):
    """Orders of weekly rebalances: rings and holdings in the state store, the events replayed."""
    return _lived(spark, live.orders(event_bars(event_stream(spark, sf_dir)), RING, TOP, "week"), live.ORDERS)


@query("x04_warm_start", f"""WITH {_SNAPSHOTS} SELECT book, key, "at", round(momentum, 6) AS momentum, round(volatility, 6) AS volatility FROM ring WHERE "at" > TIMESTAMP '2024-01-10'""")
def x04_warm(spark, sf_dir):
    """Weekly features of a stream that starts in mid-month from state filled by a batch of history."""
    past = event_bars(spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("ts") <= F.lit(BEGIN)))
    return _lived(spark, live.snapshots(event_bars(event_stream(spark, sf_dir).filter(F.col("ts") > F.lit(BEGIN))), RING, "week", history=past, begin=BEGIN), live.FEATURES)
