"""Language identification: a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 in windows of ``CORE`` bytes, so every byte of every text gets a label; each direction starts
``MARGIN`` bytes outside the window, so the states at a window's rim know what lies beyond it. In each
direction a gated recurrent cell reads the window; its update gate and candidate come from a table row per byte plus a
recurrent matrix. A softmax over both states labels each position; a document's probabilities are the mean over its
positions. The network is trained in numpy by backpropagation through time (Adam) on a bounded sample of labelled rows:
``SAMPLE_DOCS`` documents with the smallest id hashes, and of each the windows, or ``SAMPLE_WINDOWS`` of them at even distances
over the whole text if there are more; prediction reads all of every text.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled rows there is no model
and every text is ``und``; repeated rows get equal results; an empty table gives no rows. A language that the sample
does not hold is never predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import table, text_buffer

CORE, MARGIN, HIDDEN, SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS, BATCH = 96, 16, 8, 1200, 64, 260, 160
LENGTH = CORE + 2 * MARGIN


class ByteGRU:
    """The network. Arrays are feature-major: (features, positions)."""

    def __init__(self, labels: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        s = 1 / np.sqrt(hidden)
        self.p = {}
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.5, (2 * hidden, 256)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, s, (2 * hidden, hidden)).astype(np.float32)
        self.p["W"] = rng.normal(0, s, (len(labels), 2 * hidden)).astype(np.float32)
        self.p["c"] = np.zeros((len(labels), 1), np.float32)

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction for bytes ``x`` (positions, windows)."""
        h, (length, width) = self.h, x.shape
        table, u = self.p[f"E{d}"], self.p[f"U{d}"]
        inputs = np.ascontiguousarray(table.T).take(x, axis=0)  # (positions, windows, 2h)
        scratch = np.empty((2 * h, width), np.float32)
        state, out = np.zeros((h, width), np.float32), np.empty((length, h, width), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = np.matmul(u, state, out=scratch if keep is None else None)
            a += inputs[t].T
            np.tanh(a, out=a)
            z, n = a[:h] * np.float32(0.5), a[h:]
            z += np.float32(0.5)
            if keep is not None:
                keep.append((t, a, z, state))
            state = np.subtract(state, n, out=out[t])
            state *= z
            state += n
        return out

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(positions, labels, windows) for bytes (positions, windows)."""
        steps = {d: None if keep is None else [] for d in "fb"}
        both = np.concatenate([self._states(x, d, steps[d]) for d in "fb"], axis=1)
        logits = np.matmul(self.p["W"], both) + self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if keep is not None:
            keep |= {"both": both, "steps": steps}
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over valid positions, and its gradients by backpropagation through time."""
        keep: dict = {}
        p = self.probabilities(x, keep)
        w = (valid / max(1, valid.sum())).astype(np.float32)
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(y, x.shape)[:, None, :], 1)[:, 0] + 1e-9) * w).sum())
        delta = p.copy()
        np.put_along_axis(delta, np.broadcast_to(y, x.shape)[:, None, :], np.take_along_axis(delta, np.broadcast_to(y, x.shape)[:, None, :], 1) - 1, 1)
        delta *= w[:, None, :]
        g = {"W": np.einsum("tlb,thb->lh", delta, keep["both"], optimize=True), "c": delta.sum((0, 2))[:, None]}
        back, h = np.matmul(self.p["W"].T, delta), self.h
        for i, d in enumerate("fb"):
            u, du = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"])
            carry, da_all = np.zeros((h, x.shape[1]), np.float32), np.empty((*x.shape, 2 * h), np.float32)
            for t, a, z, before in reversed(keep["steps"][d]):
                dh, n = carry + back[t, i * h : (i + 1) * h], a[h:]
                da = np.concatenate([dh * (before - n) * 0.5 * (1 - a[:h] ** 2), dh * (1 - z) * (1 - n * n)])
                du += da @ before.T
                carry = dh * z + u.T @ da
                da_all[t] = da.T
            g[f"U{d}"] = du
            flat, codes = da_all.reshape(-1, 2 * h), x.ravel()
            g[f"E{d}"] = np.stack([np.bincount(codes, flat[:, j], 256) for j in range(2 * h)]).astype(np.float32)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> ByteGRU:
        """Adam on windows drawn evenly over the labels."""
        rng, m, v = np.random.default_rng(seed), {}, {}
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, batch // len(by_label) + 1) for rows in by_label if len(rows)])
            _, g = self.gradients(x[:, pick], y[pick], valid[:, pick])
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, d in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offs: np.ndarray, block: int = 1536) -> np.ndarray:
        """Mean probabilities (documents, labels) of the documents data[offs[i]:offs[i+1]]; zeros for empty ones."""
        at, doc = windows(offs)
        total = np.zeros((len(offs) - 1, len(self.labels)))
        for lo in range(0, len(at), block):
            x, inside = gathered(data, offs, at[lo : lo + block], doc[lo : lo + block])
            p = self.probabilities(x)[MARGIN : MARGIN + CORE]
            if not inside.all():
                p *= inside[:, None, :]
            np.add.at(total, doc[lo : lo + block], p.sum(axis=0).T)
        return total / np.maximum(1, np.diff(offs))[:, None]


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and document of every window."""
    sizes = np.diff(offs)
    per = -(-sizes // CORE)
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return offs[:-1][doc] + CORE * number, doc


def gathered(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (LENGTH, windows) with both margins, 0 outside the document; and which of the CORE positions lie inside."""
    at = starts + np.arange(-MARGIN, CORE + MARGIN)[:, None]
    inside = (at >= offs[:-1][doc]) & (at < offs[1:][doc])
    x = data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(inside, x, np.uint8(0)), inside[MARGIN : MARGIN + CORE]


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language, a text, and an id outside the held-out quarter."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteGRU | None:
    """Fit the network on at most ``sample_docs`` labelled documents; the sample is the same at any partitioning."""
    # ids first, so that no task sends the driver more than ids; then the texts of at most ``sample_docs`` ids
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = learnable(docs).join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("o"), F.col("text").cast("string").alias("text"), "lang")
    kinds = "o long, lang string, size int, windows array<binary>"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each text, with margins, at most ``SAMPLE_WINDOWS`` of it."""
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            at, doc = windows(offs)
            taken = []
            for i in range(len(offs) - 1):
                mine = np.flatnonzero(doc == i)
                mine = mine[np.unique(np.linspace(0, len(mine) - 1, min(len(mine), SAMPLE_WINDOWS)).astype(int))] if len(mine) else mine
                x, inside = gathered(data, offs, at[mine], doc[mine])
                taken.append([bytes(x[:, j]) + bytes([int(inside[:, j].sum())]) for j in range(len(mine))])
            yield pa.RecordBatch.from_arrays([b.column("o"), b.column("lang"), pa.array(np.diff(offs), pa.int32()), pa.array(taken, pa.list_(pa.binary()))], names=["o", "lang", "size", "windows"])

    rows = [r for r in rows.mapInArrow(sample, kinds).orderBy("o", "lang", "size", "windows").limit(sample_docs).collect() if r["windows"]]
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    x = np.frombuffer(b"".join(w for r in rows for w in r["windows"]), np.uint8).reshape(-1, LENGTH + 1).T
    y = np.repeat([labels.index(r["lang"]) for r in rows], [len(r["windows"]) for r in rows])
    core = np.arange(LENGTH)[:, None] - MARGIN
    return ByteGRU(labels).fit(np.ascontiguousarray(x[:LENGTH]), y, (core >= 0) & (core < x[LENGTH]))


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """``docs`` with lang_pred (string) and score (double); other columns with these names give way."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*keep)
    schema = [*docs.schema.fields]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in b.column("text").to_pylist()], bool)
            names, score = np.full(len(letters), "und", object), np.zeros(len(letters))
            if model is not None and letters.any():
                p = model.pooled(data, offs)
                best = p.argmax(axis=1)
                names = np.where(letters, np.array(model.labels, object)[best], "und")
                score = np.where(letters, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, T.StructType([*schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
