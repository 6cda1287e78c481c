"""Column expressions: guarded arithmetic, rolling frames with a minimum count, ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def by_ticker(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "ticker").orderBy("date")


def rolling(x: Column, n: int, agg: Callable[[Column], Column], w: WindowSpec, least: int | None = None) -> Column:
    """agg over the last n rows, NULL unless ``least`` (default n) of their values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """x / lag(x, n) - 1; a missing value on either side gives NULL, nothing is padded."""
    return ratio(x, F.lag(x, n).over(w)) - 1


def forward_return(x: Column, n: int, w: WindowSpec) -> Column:
    return ratio(F.lead(x, n).over(w), x) - 1


def rolling_z(x: Column, n: int, w: WindowSpec) -> Column:
    return ratio(x - rolling(x, n, F.avg, w), rolling(x, n, F.stddev_samp, w))


def mean_rank(x: Column, *keys: Column | str, descending: bool = False) -> Column:
    """Rank within the keys; ties share the mean of their ranks."""
    order = x.desc() if descending else x.asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2.0


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL, not an error, at zero variance."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def standard(x: Column, w: WindowSpec, least: int = 1) -> Column:
    """(x - mean) / sd within the window; 0 for every row where sd is 0, NULL under ``least`` values or with one value."""
    sd = F.stddev_samp(x).over(w)
    z = F.when(sd == 0, F.lit(0.0)).when(sd.isNotNull(), (x - F.avg(x).over(w)) / sd)
    return F.when(F.count(x).over(w) >= least, z)
