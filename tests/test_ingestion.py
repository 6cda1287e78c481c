"""Sources and sinks: the data source, the incremental store, folder ingestion, the trained scorer, models with saved state."""

import datetime as dt
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import scorer
from alphaloom.plans import model
from alphaloom.sources import feed, files, ingestion, store

BARS = "date date, ticker string, open double, high double, low double, close double, volume double"


def some_bars(spark, days, tickers="AB"):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(d), t, 1.0, 2.0, 0.5, float(d), 10.0) for d in days for t in tickers], BARS)


# --- the data source -------------------------------------------------------------------------------------------------


def test_feed_pushes_filters_and_skips_files(spark, tmp_path):
    path = str(tmp_path / "bars")
    for part in (range(0, 10), range(10, 20), range(20, 30)):
        some_bars(spark, part).coalesce(1).write.mode("append").parquet(path)
    reader = feed.PushingBarReader(path)
    cut = dt.date(2024, 1, 21)
    left = list(reader.pushFilters([feed.EqualTo(("ticker",), "A"), feed.GreaterThanOrEqual(("date",), cut), feed.EqualTo(("close",), 3.0)]))
    assert [type(f) for f in left] == [feed.EqualTo] and left[0].attribute == ("close",)  # Spark filters what the reader does not
    parts = reader.partitions()
    assert len(parts) == 1  # of three files
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 10
    feed.register(spark, push=True)
    d = lambda push="true": spark.read.format("bar_feed").option("path", path).option("push", push)
    assert d().load().filter((F.col("ticker") == "A") & (F.col("date") >= F.lit(cut)) & (F.col("close") > 25)).count() == 4
    assert d().load().count() == 60 and d().load().filter(F.col("ticker").isin("B", "C")).count() == 30
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    some = d("false").option("start", "2024-01-09").option("end", "2024-01-12").option("tickers", "A,C").load()
    assert some.count() == 4 and some.filter("close > 9").count() == 2 and some.count() == 4


def test_feed_streams_new_dates_once(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("bars", "out", "state"))
    feed.register(spark)

    def run():
        d = spark.readStream.format("bar_feed").option("path", path).load()
        d.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["date"].day, r["ticker"]) for r in spark.read.schema(BARS).parquet(out).collect())

    some_bars(spark, range(0, 5)).write.parquet(path)
    first = run()
    assert first == [(d, t) for d in range(1, 6) for t in "AB"] and run() == first
    some_bars(spark, range(5, 8)).write.mode("append").parquet(path)
    some_bars(spark, range(2, 3), "L").write.mode("append").parquet(path)  # late: its date was handed out
    assert run() == [(d, t) for d in range(1, 9) for t in "AB"]


# --- files -----------------------------------------------------------------------------------------------------------


def test_files_round_trip(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return some_bars(spark, range(30))

    path = str(tmp_path / "bars")
    for _ in range(2):
        files.cached(spark, path, make)
    assert len(made) == 1
    d = files.read_bars(spark, path, tickers=["A"], start="2024-01-20", end="2024-01-25", warm_up_days=5)
    assert (d.count(), d.agg(F.min("date")).first()[0]) == (11, dt.date(2024, 1, 15))
    counts = spark.createDataFrame([("S", dt.date(2024, 1, 5), 3.0, 1.0), ("S", dt.date(2024, 1, 6), None, 1.0), ("T", dt.date(2024, 2, 6), float("nan"), 1.0)], "symbol string, date date, dbuys double, dsells double")
    files.write_csv(counts, str(tmp_path / "c-1.csv"))
    assert [tuple(r) for r in files.read_counts(spark, str(tmp_path / "c-*.csv")).collect()] == [("S", dt.date(2024, 1, 5), 3.0, 1.0, 4.0, dt.date(2024, 1, 1))]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("one\ntwo")
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path / "texts")).collect()] == ["one\ntwo"]


# --- the incremental store -------------------------------------------------------------------------------------------

ROWS = "k long, v string, version int"


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    path, put = str(tmp_path / "s"), lambda b, rows: store.ingest(spark.createDataFrame(rows, ROWS), path, b, "k", "version", 8)
    assert put("a", [(k, f"v{k}", 1) for k in range(40)]) == list(range(8))
    before = {p.name for p in (tmp_path / "s/rows/_bucket=3").iterdir()}
    assert put("b", [(2, "new", 2), (10, "old", 0), (50, "more", 1), (50, "most", 3), (50, "most", 3)]) == [2]
    assert put("b", [(7, "never", 9)]) == []  # a known batch
    assert {p.name for p in (tmp_path / "s/rows/_bucket=3").iterdir()} == before
    rows = {r["k"]: r["v"] for r in store.rows_of(spark, path, ROWS).collect()}
    assert rows == {**{k: f"v{k}" for k in range(40)}, 2: "new", 50: "most"}
    assert {r["batch"]: (r["rows"], len(r["buckets"])) for r in store.manifest(spark, path).collect()} == {"a": (40, 8), "b": (5, 1)}
    assert put("c", []) == [] and store.rows_of(spark, path, ROWS).count() == 41


def test_store_survives_an_interruption(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "s"), [(k, f"v{k}", 1) for k in range(20)]
    store.ingest(spark.createDataFrame(rows, ROWS), path, "a", "k", "version", 4)
    real = spark.createDataFrame
    new = real([(1, "x", 2), (30, "y", 1)], ROWS)

    def broken(data, schema=None, *a, **b):
        if schema == store.MANIFEST:
            raise RuntimeError("lost")
        return real(data, schema, *a, **b)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(spark, "createDataFrame", broken)
        store.ingest(new, path, "b", "k", "version", 4)  # buckets are written, the batch is not noted
    assert store.ingest(new, path, "b", "k", "version", 4) == [1, 2]
    assert {r["k"]: r["v"] for r in store.rows_of(spark, path, ROWS).collect()} == {**{k: f"v{k}" for k in range(20)}, 1: "x", 30: "y"}


def test_buckets_of_any_key(spark):
    d = spark.createDataFrame([("17",), ("-3",), ("x",), (None,), ("99999999999999999999",)], "k string").select(store.bucket_of("k", 8))
    got = [r[0] for r in d.collect()]
    assert got[:2] == [1, 5] and all(0 <= b < 8 for b in got)


# --- folder ingestion ------------------------------------------------------------------------------------------------


def test_html_text(spark):
    html = "<html><head><title>T</title></head><body><!-- no --><h1>A &amp; B</h1><script type='x'>var a = '<p>';</script><p>one  two<br>three</p>\n<p>4 < 5 &lt;b&gt;</p><STYLE>p{}</STYLE >end</body></html>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain")], "id int, h string")
    assert [r[0] for r in rows.orderBy("id").select(ingestion.html_text(F.col("h"))).collect()] == ["A & B\none two\nthree\n4 < 5 <b>\nend", None, "", "plain"]


def test_folder_is_taken_exactly_once(spark, tmp_path):
    folder, path, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    folder.mkdir()
    take = lambda: ingestion.ingest_folder(spark, str(folder), path, state, per_batch=2)
    text = lambda: {r["path"].rsplit("/", 1)[1]: r["text"] for r in store.rows_of(spark, path, ingestion.ROWS).collect()}
    for i in range(3):
        (folder / f"f{i}.html").write_text(f"<html><p>page {i}</p></html>")
    take()
    assert text() == {f"f{i}.html": f"page {i}" for i in range(3)}
    (folder / "g.txt").write_text("<b>kept</b>")
    take()
    take()
    assert text() == {**{f"f{i}.html": f"page {i}" for i in range(3)}, "g.txt": "<b>kept</b>"}
    assert store.manifest(spark, path).agg(F.sum("rows")).first()[0] == 4


def test_archives_hold_many_documents(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    put = lambda *rows: ingestion.write_archives(spark.createDataFrame(rows, "path string, value string").coalesce(1), folder)
    take = lambda: ingestion.ingest_folder(spark, folder, path, state, source=ingestion.archived)
    text = lambda: {r["path"]: r["text"] for r in store.rows_of(spark, path, ingestion.ROWS).collect()}
    put(*((f"page_id={i}", f"<html><p>page {i}</p>\r\n'\"\u2028</html>\n") for i in range(300)), ("plain", "<b>a\tb</b>\n"), ("none", ""))
    assert sum(n.startswith("part-") for n in os.listdir(folder)) == 1  # not one for each document
    take()
    first = text()
    assert len(first) == 302 and first["page_id=7"] == "page 7\n'\"\u2028" and first["plain"] == "<b>a\tb</b>\n" and first["none"] == ""
    time.sleep(1.1)  # a later version
    put(("page_id=7", "<html>new</html>"))
    take()
    take()
    assert text() == {**first, "page_id=7": "new"}


# --- the trained scorer ----------------------------------------------------------------------------------------------


def test_scorer_learns_and_scores_held_out_texts(spark):
    rng = random.Random(1)
    words = {1: "rise gain strong", -1: "fall loss weak", 0: "meet table day"}
    rows = [(i, y, " ".join(rng.choices(words[y].split() + "the of and a in".split(), k=12))) for i in range(150) for y in [rng.choice((1, -1, 0))]]
    d = spark.createDataFrame([(i, y if i < 100 else None, t) for i, y, t in rows] + [(900, None, None), (901, None, "unseen words only"), (902, None, "")], "id int, y int, text string")
    out = {r["id"]: r for r in scorer.scores(d, "id", "text", scorer.fit(d, "id", "text", "y", steps=20)).collect()}
    assert len(out) == 153
    name = lambda r: max((r["positive"], 1), (r["negative"], -1), (r["neutral"], 0))[1]
    assert sum(name(out[i]) == y for i, y, _ in rows[100:]) >= 46  # of 50 texts that the fit did not see
    assert all(abs(r["positive"] + r["negative"] + r["neutral"] - 1) < 1e-9 and abs(r["compound"] - r["positive"] + r["negative"]) < 1e-9 for r in out.values())
    assert out[900]["compound"] == pytest.approx(out[902]["compound"]) == pytest.approx(out[901]["compound"])
    none = d.withColumn("y", F.lit(None).cast("int"))
    assert scorer.scores(d, "id", "text", scorer.fit(none, "id", "text", "y", steps=1)).agg(F.max(F.abs(F.col("positive") - 1 / 3))).first()[0] < 1e-12


def test_scorer_is_the_same_whatever_is_broadcast(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, rng.choice((1, -1, 0)), " ".join(rng.choices("abcdefgh", k=9)) + f" only{'x' * i}") for i in range(40)], "id int, y int, text string")
    run = lambda *limits: {r["id"]: r["compound"] for r in scorer.scores(d, "id", "text", scorer.fit(d, "id", "text", "y", 3, 6.0, 1e-3, *limits)).collect()}
    every, none, some = run(), run(0, 0), run(4, 0)
    assert len(every) == 40 and none == pytest.approx(every, abs=1e-12) and some == pytest.approx(every, abs=1e-12)


# --- models ----------------------------------------------------------------------------------------------------------


def test_model_is_fitted_saved_and_loaded(spark, tmp_path):
    rng = random.Random(2)
    days, names = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(60)], [f"T{i}" for i in range(8)]
    rows = []
    for fold in (0, 1):
        for d in days:
            for t in names:
                g = rng.gauss(0, 1)
                rows.append((fold, d, t, g, rng.gauss(0, 1), (g if fold == 0 else -g) + rng.gauss(0, 0.3)))
    panel = spark.createDataFrame(rows, "fold int, date date, ticker string, good double, idle double, fwd double")
    fitted = {}
    for fold in (0, 1):
        own = panel.filter(F.col("fold") == fold)
        m = model.SelectedFactors(["good", "idle"], own.select("date", "ticker", "fwd"), 3.0).fit(own.drop("fwd"))
        fitted[fold] = {(r["fold"], r["factor"]): r["weight"] for r in m.weights.collect()}
        m.save(str(tmp_path / f"m{fold}"))
        loaded = model.WeightedFactors.load(spark, str(tmp_path / f"m{fold}"), ["good", "idle"])
        a, b = (x.transform(own.drop("fwd")).orderBy("date", "ticker").collect() for x in (m, loaded))
        assert a == b and len(a) == 480
        assert all(math.isclose(r["score"], round(g, 9) * (1 if fold == 0 else -1), abs_tol=1e-8) for r, g in zip(a, (x[3] for x in sorted((x for x in rows if x[0] == fold), key=lambda x: (x[1], x[2]))), strict=True))
    assert fitted == {0: {(0, "good"): 1.0}, 1: {(1, "good"): -1.0}}
