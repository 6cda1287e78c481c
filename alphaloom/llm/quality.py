"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few shape features (character classes, word repetition, line repetition, lengths). Each feature is cut into
quantile bins; cyclic gradient boosting adds shallow trees, one feature after another, to a lookup table per feature, then
to tables of the pairs whose grid explains most of what is left. A score is the logistic of the sum of a text's bins.

Learned from at most ``SAMPLE`` labelled documents with the smallest id hashes, none of the held-out fifth; scored on all
whole texts. Defined results: null and empty texts have all-zero features and are scored like any text; without labelled
rows every score is 0.5; null labels do not count; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import span_hashes, table, text_buffer, words_of

SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 6000, 32, 8, 6, 150, 0.15
NAMES = ["symbols", "upper", "digits", "marks", "bars", "exclaims", "spaces", "beyond_ascii", "distinct_words", "repeats_next", "word_length", "log_words", "distinct_lines", "line_length", "distinct_pairs", "top_word"]
_KIND = np.full(256, 9, np.uint8)
for _i, _set in enumerate((b"#$%&*@^~=+<>\\_{}[]/`", bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"|", b"!", b" \t\n\r\v\f", bytes(range(128, 256)))):
    _KIND[list(_set)] = _i


def text_features(data: np.ndarray) -> np.ndarray:
    """Features of one text, from its bytes."""
    out = np.zeros(len(NAMES), np.float32)
    if not len(data):
        return out
    out[:8] = np.bincount(_KIND[data], minlength=10)[:8] / len(data)
    low, starts, ends = words_of(data)
    if len(starts):
        h = span_hashes(low, starts, ends)
        count = np.unique(h, return_counts=True)[1]
        out[8] = len(count) / len(h)
        out[9] = (h[1:] == h[:-1]).mean() if len(h) > 1 else 0
        out[10], out[11] = (ends - starts).mean(), np.log1p(len(h))
        out[14] = len(np.unique(h[1:] * np.uint64(3) + h[:-1])) / max(1, len(h) - 1)
        out[15] = count.max() / len(h)
    edges = np.concatenate(([-1], np.flatnonzero(data == 10), [len(data)]))
    lines = span_hashes(data, edges[:-1] + 1, edges[1:])
    out[12], out[13] = len(np.unique(lines)) / len(lines), np.log1p(len(data) / len(lines))
    return out


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> AdditiveModel:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.pairs, self.grids = float(np.log(share / (1 - share))), [], []
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            for f, table_ in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                step = rate * _shallow(np.bincount(bins[f], y - p, len(table_)), np.bincount(bins[f], p * (1 - p), len(table_)))
                table_ += step
                score += step[bins[f]]
        p = 1 / (1 + np.exp(-score))
        gains = []
        for i in range(x.shape[1]):
            for j in range(i):
                n = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
                code = coarse[i] * n[1] + coarse[j]
                g, h = np.bincount(code, y - p, n[0] * n[1]), np.bincount(code, p * (1 - p), n[0] * n[1])
                gains.append((float((g * g / (h + 1)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
        self.grids = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(rounds // 3):
            for (i, j), grid in zip(self.pairs, self.grids, strict=True):
                p, code = 1 / (1 + np.exp(-score)), coarse[i] * grid.shape[1] + coarse[j]
                g, h = (np.bincount(code, v, grid.size).reshape(grid.shape) for v in (y - p, p * (1 - p)))
                step = rate * _quarters(g, h)
                grid += step
                score += step[coarse[i], coarse[j]]
        return self

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Logistic of the sum of the bins' entries."""
        total = np.full(len(x), self.base)
        for table_, b in zip(self.tables, self._bins(x, self.cuts), strict=True):
            total += table_[b]
        coarse = self._bins(x, self.coarse)
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 1.0) -> np.ndarray:
    """Newton steps of a tree with up to three leaves over ordered bins."""
    parts = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + least)
    while len(parts) < leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)), default=(0,))
        if best[0] <= 1e-9:
            break
        parts.remove((best[1], best[3]))
        parts += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + least)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Newton steps of the best tree with one cut on each axis."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    best, out = -1.0, np.zeros_like(g)
    for a in range(1, max(2, g.shape[0])):
        for b in range(1, max(2, g.shape[1])):
            box = lambda c: np.array([c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]])
            gs, hs = box(cg), box(ch)
            if (value := (gs**2 / (hs + least)).sum()) > best:
                best, v = value, gs / (hs + least)
                out = np.empty_like(g)
                out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(docs: DataFrame, model: AdditiveModel | None, raw: bool) -> DataFrame:
    """``docs`` (with text) plus ``features`` (raw) or ``score``; the text goes."""
    keep = [c for c in docs.columns if c not in ("text", "features" if raw else "score")]
    extra = T.StructField("features", T.ArrayType(T.FloatType())) if raw else T.StructField("score", T.DoubleType())
    schema = T.StructType([*(docs.schema[c] for c in keep), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            x = np.array([text_features(data[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)], np.float32).reshape(-1, len(NAMES))
            new = pa.array(x.tolist(), pa.list_(pa.float32())) if raw else pa.array(model.score(x) if model else np.full(len(x), 0.5), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), new], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel | None:
    """Fit on at most ``sample`` labelled documents; the sample is the same at any partitioning."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` ids
    rows = _featured(rows, None, raw=True).select("doc_id", "quality", "features").orderBy("doc_id", "features").limit(2 * sample).collect()
    if not rows:
        return None
    return AdditiveModel().fit(np.array([r["features"] for r in rows], np.float32), np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """Columns of ``docs`` but the text, plus score (double) and predicted (1 from a score of 0.3)."""
    docs = docs.select(*(c for c in docs.columns if c != "predicted"))
    return _featured(docs, model, raw=False).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
