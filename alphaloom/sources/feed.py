"""A data source of its own for bars: a batch reader with pushed filters and a feed that replays new dates as a stream.

``spark.read.format("bar_feed").option("path", folder)`` and ``spark.readStream.format("bar_feed")`` read Parquet files of bars. A
partition is a file; options ``start``, ``end`` and ``tickers`` (comma-separated) and, with the option ``push`` and a session that
``register`` set up for it, filters on dates and tickers skip files by their statistics and rows inside them. Spark 4.1 keeps the filters that a DataFrame's first query pushed, also for
its later queries without any: with pushed filters, load anew for every query. The stream's offset is the last
date that was handed out: a batch holds the bars of all later dates that have arrived since, so a restart neither skips nor repeats one.
A bar that arrives for a date already handed out is late and is not read. Bars without a date are never part of the stream.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class BarFile(InputPartition):
    """One file, and which of its bars."""

    def __init__(self, path: str, terms: list[tuple[str, str, Any]]):
        self.path, self.terms = path, terms


_OPS = {
    "=": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(v),
}


def _condition(terms: list[tuple[str, str, Any]]):
    out = None
    for column, op, value in terms:
        x = _OPS[op](pc.field(column), value)
        out = x if out is None else out & x
    return out


def _dates(fragment) -> tuple[dt.date, dt.date] | None:
    """First and last date of a file by its statistics; None if it has none."""
    spans = [g.statistics["date"] for g in fragment.row_groups if g.statistics and "date" in g.statistics]
    return (min(s["min"] for s in spans), max(s["max"] for s in spans)) if spans else None


def _files(path: str) -> list:
    return list(ds.dataset(path, format="parquet").get_fragments())


def read_file(part: BarFile) -> Iterator:
    yield from ds.dataset(part.path, format="parquet").to_batches(columns=COLUMNS, filter=_condition(part.terms))


def _uri(path: str, file: str) -> str:
    scheme, sep, _ = path.partition("://")
    return f"{scheme}://{file}" if sep and "://" not in file else file


class BarReader(DataSourceReader):
    def __init__(self, path: str, terms: list[tuple[str, str, Any]] | None = None):
        self.path, self.terms = path, list(terms or [])

    def partitions(self) -> list[BarFile]:
        out, days = [], [(op, v) for c, op, v in self.terms if c == "date" and op != "in"]
        for f in _files(self.path):
            span = _dates(f)
            if span and any(op in (">", ">=", "=") and span[1] < v or op in ("<", "<=", "=") and span[0] > v for op, v in days):
                continue
            out.append(BarFile(_uri(self.path, f.path), self.terms))
        return out

    def read(self, partition: BarFile) -> Iterator:
        return read_file(partition)


class PushingBarReader(BarReader):
    """Takes filters over as well."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in names and len(column) == 1 and column[0] in ("date", "ticker"):
                self.terms.append((column[0], names[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f


class BarStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"date": ""}

    def latestOffset(self) -> dict:
        spans = [s for s in map(_dates, _files(self.path)) if s]
        return {"date": max(s[1] for s in spans).isoformat() if spans else ""}

    def partitions(self, start: dict, end: dict) -> list[BarFile]:
        after = dt.date.fromisoformat(start["date"]) if start["date"] else dt.date.min
        if not end["date"]:
            return []
        last = dt.date.fromisoformat(end["date"])
        terms = [("date", "<=", last)] + ([("date", ">", after)] if start["date"] else [])
        return [BarFile(_uri(self.path, f.path), terms) for f in _files(self.path) if (s := _dates(f)) and s[1] > after and s[0] <= last]

    def read(self, partition: BarFile) -> Iterator:
        return read_file(partition)


class BarFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        given, terms = self.options, []
        for name, op in (("start", ">="), ("end", "<=")):
            if name in given:
                terms.append(("date", op, dt.date.fromisoformat(given[name])))
        if "tickers" in given:
            terms.append(("ticker", "in", given["tickers"].split(",")))
        kind = PushingBarReader if given.get("push") == "true" else BarReader
        return kind(given["path"], terms)

    def streamReader(self, schema) -> BarStream:
        return BarStream(self.options["path"])


def register(spark: SparkSession, push: bool = False) -> None:
    """Make ``bar_feed`` known to the session; ``push``: its Python sources may get filters."""
    spark.dataSource.register(BarFeed)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
