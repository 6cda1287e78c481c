"""Centroid clustering in integers: Lloyd rounds whose nearest centroid comes from an Orchard search.

Every centroid has a list of the other centroids, nearest first. A vector starts at some centroid, walks its list and jumps to the
list of any closer centroid it meets (ties: the smaller number); centroids met before are marked and not measured again; the walk
stops strictly beyond twice the current distance, as by the triangle inequality none behind can be as close. Distances are squared
integers, so "twice" reads ``> 4 * distance``, and nothing is rounded.

A round is one pass over the vectors: tasks assign their vectors and add up, per centroid, components and count; Spark sums these
rows (``clusters x dimensions x limbs``, whatever the number of vectors) and the driver forms the new centroids. Sums leave tasks as
limbs of 30 bits, so no size of component overflows. Vectors whose components fit in 27 bits are measured in 64-bit integers, others in
Python integers.

Defined results: vectors that are null, have another number of components or hold null or non-finite ones are left out; a null id never
starts a centroid; with fewer vectors than clusters every vector starts one; equal vectors are all kept and go to the smaller number;
an empty table gives no rows; a squared distance or an inertia beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import table, written

SCALE, LIMB, SMALL, LARGEST = 1024, 30, 1 << 27, 2**63 - 1


def usable(vec: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) == dims) & ~F.coalesce(F.exists(vec, odd), F.lit(True))


def floors(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) / SCALE, exact in doubles of every size."""
    small = np.abs(x) < 2.0**43  # beyond, x is a multiple of 1 / SCALE already
    return np.where(small, np.floor(np.where(small, x, 0) * SCALE) / SCALE, x)


def integers(y: np.ndarray) -> np.ndarray:
    """SCALE * y of floors: 64-bit integers if all fit in 27 bits, else Python's."""
    if y.size == 0 or float(np.abs(y).max()) * SCALE < SMALL:
        return (y * SCALE).astype(np.int64)
    whole = np.empty(y.shape, object)
    whole.ravel()[:] = [int(v) * SCALE if abs(v) >= 2.0**52 else int(v * SCALE) for v in y.ravel().tolist()]
    return whole


class Orchard:
    """Nearest centroids by their neighbour lists."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        exact = np.empty((self.k, len(centroids[0])), object)
        exact[:] = centroids
        self.exact = exact
        self.small = exact.astype(np.int64) if max(abs(v) for c in centroids for v in c) < SMALL else None
        gaps = self._gaps()
        order = [sorted((j for j in range(self.k) if j != i), key=lambda j, i=i: (gaps[i][j], j)) for i in range(self.k)]
        self.near = np.array(order, np.int64).reshape(self.k, self.k - 1)
        self.beyond = np.empty((self.k, self.k - 1), object)  # squared distances between centroids along each list
        for i, js in enumerate(order):
            self.beyond[i] = [gaps[i][j] for j in js]
        if self.small is not None:
            self.beyond = self.beyond.astype(np.int64)
        self.measured = 0

    def _gaps(self) -> list[list[int]]:
        base = self.exact if self.small is None else self.small
        return [[int(v) for v in ((base - base[i]) ** 2).sum(axis=1)] for i in range(self.k)]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of ``x``, searched from the centroids ``start``."""
        exact = self.small is None or x.dtype == object
        base, beyond = (self.exact, self.beyond.astype(object)) if exact else (self.small, self.beyond)
        x = x.astype(object) if exact else x
        measure = lambda rows, cs: ((x[rows] - base[cs]) ** 2).sum(axis=1)
        n = len(x)
        at, step, seen = start.astype(np.int64).copy(), np.zeros(n, np.int64), np.zeros((n, self.k), bool)
        best = measure(np.arange(n), at)
        seen[np.arange(n), at] = True
        self.measured += n
        live = np.arange(n) if self.k > 1 else np.zeros(0, np.int64)
        while len(live):
            live = live[(beyond[at[live], step[live]] <= 4 * best[live]).astype(bool)]
            other = self.near[at[live], step[live]]
            fresh = ~seen[live, other]
            rows, cs = live[fresh], other[fresh]
            seen[rows, cs] = True
            d = measure(rows, cs)
            self.measured += len(rows)
            closer = ((d < best[rows]) | ((d == best[rows]) & (cs < at[rows]))).astype(bool)
            step[live] += 1
            jump = rows[closer]
            at[jump], best[jump], step[jump] = cs[closer], d[closer], 0
            live = live[step[live] < self.k - 1]
        return at, best


def limbs(v: int) -> Iterator[tuple[int, int]]:
    """(number, value) of the 30-bit limbs whose sum of value << (LIMB * number) is v; the last one carries the sign."""
    i = 0
    while not -(1 << LIMB) < v < 1 << LIMB:
        yield i, v & ((1 << LIMB) - 1)
        v, i = v >> LIMB, i + 1
    if v or not i:
        yield i, v


def _blocks(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(vectors: DataFrame, orchard: Orchard, dims: int) -> dict[int, list[int]]:
    """Per centroid: the sum of each component, then the count and the sum of squared distances."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x = integers(_blocks(batch, dims))
            at, d = orchard.nearest(x, batch.column("first").to_numpy())
            for c in np.unique(at).tolist():
                mine = at == c
                new = [int(v) for v in x[mine].sum(axis=0)] + [int(mine.sum()), sum(d[mine].tolist())]
                sums[c] = [a + b for a, b in zip(sums[c], new, strict=True)] if c in sums else new
        rows = [(c, i, n, v) for c, values in sums.items() for i, value in enumerate(values) for n, v in limbs(value)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "i", "limb", "v"])

    parts = vectors.select("y", "first").mapInArrow(add, "c int, i int, limb int, v long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("c", "i", "limb").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
        out.setdefault(r["c"], [0] * (dims + 2))[r["i"]] += int(r["v"]) << (LIMB * r["limb"])
    return out


def seeds(vectors: DataFrame, id_col: str, k: int, salt: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest sha256 of ``salt:id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "y").filter("digest IS NOT NULL").orderBy("digest", "y").limit(k).collect()
    return [integers(np.array(r["y"], np.float64)).tolist() for r in rows]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector; ``centroid``: its final components."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("y")).filter(usable(F.col("y"), dims))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = floors(_blocks(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * dims), pa.array(y.ravel()))], names=["id", "y"])

    centroids = seeds(rows.mapInArrow(whole, f"id {kind}, y array<double>"), "id", k, salt)
    fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>"
    if not centroids:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, {fields}")
    start = Orchard(centroids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = floors(_blocks(batch, dims))
            at, _ = start.nearest(integers(y), np.zeros(len(y), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * dims), pa.array(y.ravel())), pa.array(at.astype(np.int32))], names=["id", "y", "first"])

    # the rounds read whole numbers and start each search at the vector's first cluster
    vectors = written(rows.mapInArrow(first, f"id {kind}, y array<double>, first int"), "centroid-vectors")
    for _ in range(rounds):
        for c, sums in _sums(vectors, Orchard(centroids), dims).items():
            centroids[c] = [v // sums[dims] for v in sums[:dims]]
    final = Orchard(centroids)
    inertia = {c: sums[dims + 1] for c, sums in _sums(vectors, final, dims).items()}
    fits = lambda v: v if v is not None and v <= LARGEST else None
    total, texts = fits(sum(inertia.values())), [[str(v) for v in c] for c in centroids]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array([fits(inertia.get(c)) for c in range(len(centroids))], pa.int64())
        forms = pa.array(texts, pa.list_(pa.string()))
        for batch in batches:
            at, d = final.nearest(integers(_blocks(batch, dims)), batch.column("first").to_numpy())
            near = pa.array(at)
            columns = [batch.column("id"), pa.array(at.astype(np.int32)), pa.array([fits(int(v)) for v in d.tolist()], pa.int64()), own.take(near), pa.array([total] * len(at), pa.int64()), forms.take(near)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return vectors.mapInArrow(last, f"{id_col} {kind}, {fields}")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, salt: int = 3) -> str:
    """The rounds written out: distances of all vectors to all centroids, exact integers."""
    steps = [
        f"""x AS MATERIALIZED (SELECT r, vec_id, u.i AS i, CAST(floor(1024 * CAST(embedding[u.i] AS DOUBLE)) AS BIGINT) AS v FROM
 (SELECT row_number() OVER (ORDER BY vec_id) AS r, * FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0) CROSS JOIN (SELECT unnest(range(1, {dims + 1})) AS i) u)""",
        f"""c0 AS MATERIALIZED (SELECT c, i, v FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT r, vec_id FROM x) QUALIFY c < {k}) USING (r))""",
    ]
    for j in range(rounds + 1):
        steps.append(f"""a{j} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((x.v - k.v) * (x.v - k.v)) AS d FROM x JOIN c{j} k USING (i) GROUP BY r, c) GROUP BY r)""")
        if j < rounds:
            steps.append(f"""c{j + 1} AS MATERIALIZED (SELECT c, i, coalesce(n.v, o.v) AS v FROM c{j} o LEFT JOIN
 (SELECT c, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN a{j} USING (r) GROUP BY c, i) n USING (c, i))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT DISTINCT r, vec_id FROM x) USING (r) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""


ORACLE = _oracle()
