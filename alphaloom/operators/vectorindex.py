"""A persisted index of vectors for exact cosine search: inverted lists around centroids, each with its radius.

``build`` fits centroids to a bounded sample and writes every vector to the list of its nearest one, a folder per list; ``upsert`` replaces
and adds vectors and rewrites only the lists that this touches; ``search`` reads only the lists that can hold one of a query's k best.

The cut is exact. A list's radius is the largest angle between its centroid and a vector of it, so for a query at angle t from the centroid
no vector of the list has a cosine above ``cos(t - radius)``. A first pass reads the most promising lists, k vectors at least, and gives
each query its k-th best cosine; a second pass reads the lists whose bound reaches it.

Zero vectors have no cosine: they stand in list -1, which is read only for queries that the other lists leave short of k. Null vectors
and vectors of another length than the centroids' are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.session import staged

SAMPLE, MOST_LISTS, ROUNDS, SLACK = 20_000, 4096, 8, 1e-8


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norm > 0, norm, 1)[:, None], norm


def fit(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Unit centroids by spherical k-means over at most SAMPLE vectors, those with the smallest hashes of their ids; about sqrt(rows) of them."""
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    lists = min(MOST_LISTS, lists or max(1, int(np.sqrt(rows.count()))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(F.col("embedding").cast("array<double>").alias("e")).collect()
    size = max((len(r["e"]) for r in sample), default=0)
    x, norm = _unit(np.array([r["e"] for r in sample if len(r["e"]) == size], float).reshape(-1, size))
    x = x[norm > 0]
    centroids = x[:lists]
    for _ in range(ROUNDS):
        if not len(x):
            break
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        moved, weight = _unit(sums)
        centroids = np.where(weight[:, None] > 0, moved, centroids)
    return centroids


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, embedding, list, angle)."""
    d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & (F.size("embedding") == centroids.shape[1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norm = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1]))
            cos = x @ centroids.T if len(centroids) else np.zeros((len(x), 1))
            near = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), near], -1, 1))
            zero = ~(norm > 0)
            columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(np.where(zero, -1, near).astype(np.int32)), pa.array(np.where(zero, 0.0, angle))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "list", "angle"])

    return d.mapInArrow(place, f"vec_id {d.schema['vec_id'].dataType.simpleString()}, embedding array<double>, list int, angle double")


def _radii(rows: DataFrame) -> DataFrame:
    return rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))


def _write_lists(spark: SparkSession, path: str, centroids: np.ndarray, radii: dict[int, tuple[float, int]]) -> None:
    rows = [(i, centroids[i].tolist() if i >= 0 else None, *radii.get(i, (0.0, 0))) for i in range(-1, len(centroids))]
    spark.createDataFrame(rows, "list int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def _read_lists(spark: SparkSession, path: str) -> tuple[np.ndarray, dict[int, tuple[float, int]]]:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS and one at most
    return np.array([r["centroid"] for r in rows if r["list"] >= 0], float), {r["list"]: (r["radius"], r["n"]) for r in rows}


def _read_vectors(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"vec_id {id_type}, embedding array<double>, angle double, list int").parquet(f"{path}/vectors")


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Write an index of ``vectors`` (vec_id, embedding) to ``path``, replacing one that is there."""
    centroids = fit(vectors, lists)
    rows = staged(_assigned(vectors, centroids), "vector-lists")
    _write_lists(vectors.sparkSession, path, centroids, {r["list"]: (r["radius"], r["n"]) for r in _radii(rows).collect()})
    # lists of any size: adaptive execution splits large ones over tasks
    rows.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")


def upsert(vectors: DataFrame, path: str) -> list[int]:
    """Replace and add ``vectors``, one row an id; returns the lists that were rewritten."""
    spark = vectors.sparkSession
    centroids, radii = _read_lists(spark, path)
    new = staged(_assigned(vectors, centroids), "vector-new")
    old = _read_vectors(spark, path, new.schema["vec_id"].dataType.simpleString())
    replaced = old.select("vec_id", "list").join(new.select("vec_id"), "vec_id", "left_semi")
    touched = sorted({r["list"] for r in replaced.select("list").distinct().collect()} | {r["list"] for r in new.select("list").distinct().collect()})
    here = old.filter(F.col("list").isin(touched))
    rows = staged(here.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new), "vector-touched")
    now = {r["list"]: (r["radius"], r["n"]) for r in _radii(rows).collect()}
    # radii grow before vectors move, so that an index left in between still cuts nothing that it holds
    _write_lists(spark, path, centroids, radii | {i: (max(radii[i][0], now.get(i, (0.0, 0))[0]), now.get(i, (0.0, 0))[1]) for i in touched})
    rows.hint("rebalance", "list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/vectors")
    jvm = spark.sparkContext._jvm
    for i in set(touched) - set(now):  # lists that lost all their vectors
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/vectors/list={i}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return touched


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, id_type: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, similarity, pos) of each query's k most similar vectors, ties by id, and (list, n, queries) of the lists read.

    ``queries``: (query_id, q). The same rows as a comparison with every vector; cosines are rounded to nine digits.
    """
    centroids, radii = _read_lists(spark, path)
    size = np.array([radii[i][1] for i in range(len(centroids))], np.int64)
    radius = np.array([radii[i][0] for i in range(len(centroids))])
    q = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter(F.size("q") == centroids.shape[1])
    kind = q.schema["query_id"].dataType.simpleString()

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _unit(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1]))
            angle = np.arccos(np.clip(x @ centroids.T, -1, 1))
            most = np.where(size > 0, np.cos(np.maximum(0, angle - radius)), -2.0)
            order = np.argsort(-most, axis=1, kind="stable")
            ahead = np.cumsum(size[order], axis=1) - size[order]  # vectors in the lists before
            row, pos = np.nonzero(size[order] > 0)
            lists = order[row, pos]
            columns = [batch.column("query_id").take(pa.array(row)), batch.column("q").take(pa.array(row)), pa.array(lists.astype(np.int32)), pa.array(most[row, lists]), pa.array(ahead[row, pos] < k)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "q", "list", "most", "first"])

    pairs = staged(q.mapInArrow(bounds, f"query_id {kind}, q array<double>, list int, most double, first boolean"), "vector-bounds")
    vectors = _read_vectors(spark, path, id_type)
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "vec_id")

    def compared(asked: DataFrame) -> DataFrame:
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # bounded by the lists
        both = vectors.filter(F.col("list").isin(lists)).join(asked.select("query_id", "q", "list"), "list")
        sim = F.round(F.try_divide(dot("embedding", "q"), F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q", "q"))), 9)
        # k rows a query leave each task
        return both.select("query_id", "vec_id", sim.alias("similarity")).withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k).drop("pos")

    found = staged(compared(pairs.filter("first")), "vector-first")
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least"))
    more = staged(pairs.filter("NOT first").join(least, "query_id").filter(F.col("most") >= F.coalesce("least", F.lit(-2.0)) - SLACK).select("query_id", "q", "list"), "vector-more")
    found = staged(found.unionByName(compared(more)).withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k), "vector-found")
    short = q.join(found.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti").select("query_id", "q", F.lit(-1).alias("list"))
    if radii[-1][1] and short.limit(1).count():
        found = found.drop("pos").unionByName(compared(short)).withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k)
    read = pairs.filter("first").select("list", "query_id").unionByName(more.select("list", "query_id")).groupBy("list").agg(F.count("*").alias("queries"))
    read = read.join(spark.read.parquet(f"{path}/lists").select("list", "n"), "list").select("list", "n", "queries")
    return found.withColumn("pos", F.col("pos").cast("int")), read
