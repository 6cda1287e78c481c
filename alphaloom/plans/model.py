"""Alpha models: what turns panels into signals, as estimators with saved state."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.operators import factors, ic


class AlphaModel(ABC):
    """A named model; ``fit`` may learn from a panel, ``signals`` returns (date, ticker, score)."""

    name = "alpha"

    def fit(self, panel: DataFrame) -> AlphaModel:
        return self

    @abstractmethod
    def signals(self, bars: DataFrame) -> DataFrame: ...


class FactorModel(AlphaModel):
    """Technical factors, normalised per date (or sector), weighted; nothing is learned."""

    name = "factors"

    def __init__(self, weights: dict[str, float] | None = None, sectors: DataFrame | None = None):
        self.weights, self.sectors = weights, sectors

    def signals(self, bars: DataFrame) -> DataFrame:
        z = factors.normalise(factors.complete(factors.technical(bars)), factors.TECHNICAL, self.sectors)
        return z.select("date", "ticker", factors.composite(self.weights, factors.TECHNICAL).alias("score"))


class SelectedFactors(Estimator):
    """Learns, for each fold, the sign of every factor whose rank IC is significant in the fold's panel.

    ``returns``: (date, ticker, fwd). A panel without the ``fold`` column is one fold, number 0.
    """

    def __init__(self, names: list[str], returns: DataFrame, threshold: float = 2.0):
        super().__init__()
        self.names, self.returns, self.threshold = names, returns, threshold

    def _fit(self, panel: DataFrame) -> WeightedFactors:
        d = panel if "fold" in panel.columns else panel.withColumn("fold", F.lit(0))
        found = ic.ic_summary(ic.rank_ic(factors.long_form(d, self.names, "fold"), self.returns, "fold"), "fold")
        return WeightedFactors(self.names, ic.select_factors(found, self.threshold).filter("weight <> 0").select("fold", "factor", F.col("weight").cast("double").alias("weight")))


class WeightedFactors(Transformer):
    """Scores rows by the weights of their fold, (fold, factor, weight) with a row for each fold and factor; folds without one drop out."""

    def __init__(self, names: list[str], weights: DataFrame):
        super().__init__()
        self.names, self.weights = names, weights

    def _transform(self, panel: DataFrame) -> DataFrame:
        d = panel if "fold" in panel.columns else panel.withColumn("fold", F.lit(0))
        long = factors.long_form(d, self.names, "fold").join(F.broadcast(self.weights), ["fold", "factor"])
        return long.groupBy("fold", "date", "ticker").agg(F.round(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0))), 9).alias("score"))

    def save(self, path: str) -> None:
        self.weights.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, names: list[str]) -> WeightedFactors:
        return WeightedFactors(names, spark.read.parquet(path))
