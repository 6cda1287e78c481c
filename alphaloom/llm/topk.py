"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances: a vector x gets the coordinate sqrt(M - |x|^2), M the largest squared norm, a query gets
0, and |q - x|^2 = |q|^2 + M - 2 q.x. Vectors are collapsed to distinct ones (each with its smallest ids: more than
k + 1 of a tie can never be returned), assigned to their nearest of at most ``ROOTS`` pivots and cut into blocks of about
``BLOCK`` vectors. Each block is one M-tree: paged nodes that hold covering radii and the distances of their entries
to the parent entry.

A tree is searched for many queries at once: pages are taken in the order of the least bound that any query has for them,
with the queries whose own bound still allows the page. For these, entries are skipped on
|d(q, parent) - d(entry, parent)| before any distance is computed, subtrees on d(q, entry) - radius, and what is left is one
matrix product a page. Every query first searches the block nearest to it, which gives it a k-th score; then it goes only to
the blocks whose covering radius may beat that score. Queries travel in slices of about ``ASKED`` neighbours, and a block is
copied only to the slices that need it. Scores are integers; bounds carry a slack above float error, so ties are all seen
and go to the smaller id.

Defined results: vectors that are null or hold a null or non-finite component take no part; null ids take no part; vectors
shorter than the longest count as zero beyond their end (an empty one scores 0 with all); rows that repeat an id and a
vector are one row; different vectors of one id are queries each, with ranks of their own, and are no candidates for that
id; components and scores beyond 64 bits stop at the limit; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import forget, table, written

ROOTS, BLOCK, PAGE, TOP, EVERY, ASKED = 64, 8192, 128, 5, 50, 4096
#: Integers that doubles hold exactly; products of larger vectors are computed in Python integers.
EXACT = 2**53


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): integer components floor(256 x) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(x, bad))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


class MTree:
    """An M-tree over the rows of ``points``, bulk-built top-down; distances are Euclidean."""

    def __init__(self, points: np.ndarray, page: int = PAGE, seed: int = 5):
        self.points, self.page, self.rng = points, page, np.random.default_rng(seed)
        self.norms = (points * points).sum(axis=1)
        self.root = self._node(np.arange(len(points)), None)

    def _node(self, rows: np.ndarray, parent: np.ndarray | None) -> dict:
        """A page: rows of the points, their parent distances and, above the leaves, covering radii and children."""
        p = self.points[rows]
        to_parent = lambda x: np.zeros(len(x)) if parent is None else np.sqrt(((x - parent) ** 2).sum(axis=1))
        if len(rows) <= self.page:
            return {"rows": rows, "up": to_parent(p), "radius": 0.0, "children": None}
        pick = self.rng.choice(len(rows), min(self.page, -(-len(rows) // (self.page // 2))), replace=False)
        pivots = p[pick]
        d = np.maximum(0, self.norms[rows][:, None] + self.norms[rows[pick]][None] - 2 * p @ pivots.T)
        nearest = d.argmin(axis=1)
        if len(np.unique(nearest)) == 1:  # equal points: split evenly
            nearest = np.arange(len(rows)) % len(pick)
        children, radii, keep = [], [], []
        for j in range(len(pick)):
            mine = rows[nearest == j]
            if len(mine):
                radii.append(np.sqrt(((self.points[mine] - pivots[j]) ** 2).sum(axis=1)).max())
                children.append(self._node(mine, pivots[j]))
                keep.append(j)
        return {"rows": rows[pick[keep]], "up": to_parent(pivots[keep]), "radius": np.array(radii), "children": children}

    def search(self, queries: np.ndarray, limits: np.ndarray, offer) -> int:
        """Best-first search for all ``queries``; ``limits`` are their largest distances of interest, which ``offer`` may lower.

        ``offer(rows, who)`` gets leaf rows and the queries that may have one of them within their limit. Returns the number
        of distances computed. Limits must allow for the rounding of squared distances.
        """
        norms = (queries * queries).sum(axis=1)
        everyone = np.arange(len(queries))
        heap = [(0.0, 0, self.root, everyone, np.zeros(len(queries)), None)]
        tick, computed = 0, 0
        while heap:
            _, _, node, who, lower, d_parent = heapq.heappop(heap)
            live = np.flatnonzero(lower <= limits[who])
            if not len(live):
                continue
            who, rows = who[live], node["rows"]
            may = None
            if d_parent is not None:
                may = np.abs(node["up"][None, :] - d_parent[live][:, None]) <= node["radius"] + limits[who][:, None]
                some, cols = may.any(axis=1), may.any(axis=0)
                if not some.any():
                    continue
                who, may = who[some], may[np.ix_(some, cols)]
                rows = rows[cols]
            computed += len(who) * len(rows)
            if node["children"] is None:
                offer(rows, who)
                continue
            d = np.sqrt(np.maximum(0, norms[who][:, None] + self.norms[rows][None] - 2 * queries[who] @ self.points[rows].T))
            at = np.arange(len(rows)) if may is None else np.flatnonzero(cols)
            low = np.maximum(0, d - node["radius"][at][None, :])
            wanted = low <= limits[who][:, None]
            if may is not None:
                wanted &= may
            for j in np.flatnonzero(wanted.any(axis=0)).tolist():
                q = np.flatnonzero(wanted[:, j])
                tick += 1
                heapq.heappush(heap, (float(low[q, j].min()), tick, node["children"][at[j]], who[q], low[q, j], d[q, j]))
        return computed


def _padded(vectors, width: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that makes all of them equally long."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))])


def _search(points: pd.DataFrame, queries: pd.DataFrame, width: int, most: float, top: int) -> list[tuple]:
    """(query_id, qh, vec_id, score) of the best of one block for each query; ``floor`` is a score that is reached already."""
    exact = most < EXACT
    x, q = (_padded(part["v"], width).astype(float if exact else object) for part in (points, queries))
    tree, ids = MTree(_lifted(x, most)), points["ids"].to_numpy()
    slack, base = 1e-6 * (1 + most), (q.astype(float) ** 2).sum(axis=1) + most
    floors = queries["floor"].to_numpy(float, na_value=-np.inf)
    limits = np.sqrt(np.maximum(0, base - 2 * floors + slack))
    own, best = queries["query_id"].tolist(), [[] for _ in range(len(q))]  # best: heaps of (score, -vec_id), the worst first

    def offer(rows: np.ndarray, who: np.ndarray) -> None:
        scores = q[who] @ x[rows].T
        for i, s in zip(who.tolist(), scores, strict=True):
            mine = best[i]
            at = np.flatnonzero(s >= floors[i])
            if len(mine) == top and len(at) > top:
                at = at[np.argsort(-s[at].astype(float), kind="stable")]
            for r in at.tolist():
                score = int(s[r])
                if len(mine) == top and score < mine[0][0]:
                    continue
                for v in ids[rows[r]]:
                    if v == own[i]:
                        continue
                    if len(mine) < top:
                        heapq.heappush(mine, (score, -int(v)))
                    elif (score, -int(v)) > mine[0]:
                        heapq.heapreplace(mine, (score, -int(v)))
            if len(mine) == top and mine[0][0] > floors[i]:
                floors[i] = float(mine[0][0]) if exact else np.nextafter(float(mine[0][0]), -np.inf)
                limits[i] = np.sqrt(max(0.0, base[i] - 2 * floors[i] + slack))

    tree.search(_lifted(q, 0.0), limits, offer)
    cut = lambda score: max(-(2**63), min(2**63 - 1, score))
    return [(i, h, -v, cut(s)) for i, h, mine in zip(own, queries["qh"], best, strict=True) for s, v in mine]


def top_k(rows: DataFrame, top: int = TOP, every: int = EVERY, roots: int = ROOTS, block: int = BLOCK, asked_in_slice: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` largest inner products of each row with vec_id divisible by ``every``."""
    spark = rows.sparkSession
    vectors = usable(rows)
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.dense_rank().over(by_vector)).filter(F.col("r") <= top + 1)
    points = written(few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "topk-points")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    width, most, n = points.agg(F.max(F.size("v")), F.max(norm), F.count("*")).first()
    result = "query_id long, qh long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    count = min(roots, max(1, n // block))
    pivots = np.stack([_lifted(_padded([r["v"]], width), most)[0] for r in points.orderBy(F.xxhash64("v")).limit(count).collect()])  # ROOTS rows at most
    away = lambda x: np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = away(_lifted(_padded(pdf["v"], width), most))
            yield pdf.assign(root=d.argmin(axis=1), far=d.min(axis=1))

    placed = written(points.mapInPandas(place, "v array<bigint>, ids array<bigint>, root int, far double"), "topk-placed")
    sizes = {r["root"]: (r["n"], r["far"]) for r in placed.groupBy("root").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # ROOTS rows at most
    parts = {root: -(-m // block) for root, (m, _) in sizes.items()}
    per_root = lambda numbers: F.element_at(F.create_map(*(F.lit(y) for kv in numbers.items() for y in kv)), F.col("root"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("v"), per_root(parts)).cast("int"))
    seen = np.array(sorted(sizes))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest root of each query."""
        for pdf in batches:
            d = away(_lifted(_padded(pdf["v"], width), 0.0))[:, seen]
            yield pdf.assign(home=seen[d.argmin(axis=1)].astype(np.int32))

    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "v").alias("qh"), "v").dropDuplicates(["query_id", "qh"])
    asked = written(asked.mapInPandas(settle, "query_id long, qh long, v array<bigint>, home int"), "topk-asked")
    homes = {r["home"]: -(-r["n"] // asked_in_slice) for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}  # ROOTS rows at most
    asked = asked.withColumn("root", F.col("home"))
    asked = asked.withColumn("slice", F.pmod(F.col("qh"), per_root(homes)).cast("int") if homes else F.lit(0)).drop("root")

    # a row for each query and block that it may need: all blocks but those whose covering radius its bound excludes
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = _lifted(_padded(pdf["v"], width), 0.0)
            floor = pdf["floor"].to_numpy(float, na_value=-np.inf)
            limit = np.sqrt(np.maximum(0, (q * q).sum(axis=1) + most - 2 * floor + 1e-6 * (1 + most)))
            d = away(q)
            for root in sizes:
                live = pdf[(d[:, root] - sizes[root][1] <= limit) & ((pdf["home"] != root) | (parts[root] > 1))]  # a single home block is done
                for part in range(parts[root]):
                    if len(live):
                        yield live.assign(root=root, part=part)

    keys, schema = ["root", "part", "home", "slice"], "query_id long, qh long, v array<bigint>, home int, slice int, floor double, root int, part int"

    def run(queries: DataFrame) -> DataFrame:
        """Blocks against slices: a task holds one of each."""
        needed = queries.select(*(F.col(c).alias(c) for c in keys)).distinct()
        copies = placed.join(needed, ["root", "part"])

        def group(key: tuple, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            found = _search(points, queries, width, most, top) if len(points) and len(queries) else []
            return pd.DataFrame(found, columns=["query_id", "qh", "vec_id", "score"])

        return copies.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(group, result)

    home = asked.withColumn("floor", F.lit(None).cast("double")).withColumn("root", F.col("home"))
    first = written(run(home.withColumn("part", F.pmod(F.shiftright("qh", 20), per_root(parts)).cast("int"))), "topk-first")
    floors = first.groupBy("query_id", "qh").agg(F.when(F.count("*") >= top, F.min("score")).cast("double").alias("floor"))
    second = asked.join(floors, ["query_id", "qh"], "left").select("query_id", "qh", "v", "home", "slice", "floor")
    found = written(run(written(second.mapInPandas(spread, schema), "topk-spread")).unionByName(first).distinct(), "topk-found")
    forget(points, placed, first)
    best = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 5
"""
