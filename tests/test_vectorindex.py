"""The persisted vector index against a comparison with every vector."""

import numpy as np
import pytest

from alphaloom.operators import vectorindex

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        cos = [(None if not np.any(v) else round(float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), 9), i) for i, v in rows]
        out[q] = [i for _, i in sorted(cos, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))[:k]]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    spots = rng.standard_normal((12, 6)) * 4
    rows = [(i, (spots[i % 12] + 0.2 * rng.standard_normal(6)).tolist()) for i in range(600)]
    return rows + [(600, [0.0] * 6), (601, rows[5][1]), (602, rows[5][1])], [(q, rows[q * 7][1]) for q in range(10)]


def found(spark, path, queries, k):
    hits, read = vectorindex.search(spark, path, spark.createDataFrame(queries, "query_id long, q array<double>"), k)
    out = {}
    for r in hits.orderBy("query_id", "pos").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out, read


def test_search_equals_brute_force_and_reads_less(spark, tmp_path, clustered):
    rows, queries = clustered
    path = str(tmp_path / "index")
    vectorindex.build(spark.createDataFrame(rows + [(700, None), (701, [1.0])], SCHEMA), path, 12)
    out, read = found(spark, path, queries, 5)
    assert out == brute(rows, queries, 5)
    compared = sum(r["n"] * r["queries"] for r in read.collect())
    assert compared < 0.4 * len(rows) * len(queries)  # vectors compared, of all pairs
    # more than there are: zero vectors come last
    out, _ = found(spark, path, queries[:2], 700)
    assert out == brute(rows, queries[:2], 700)


def test_upsert_moves_replaces_and_adds(spark, tmp_path, clustered):
    rows, queries = clustered
    path = str(tmp_path / "index")
    vectorindex.build(spark.createDataFrame(rows, SCHEMA), path, 12)
    change = [(0, rows[1][1]), (600, rows[2][1]), (900, rows[3][1]), (3, [0.0] * 6)]
    touched = vectorindex.upsert(spark.createDataFrame(change, SCHEMA), path)
    assert 0 < len(touched) < 13
    now = sorted({**dict(rows), **dict(change)}.items())
    for _ in range(2):  # the same rows once more change nothing
        assert found(spark, path, queries, 6)[0] == brute(now, queries, 6)
        vectorindex.upsert(spark.createDataFrame(change, SCHEMA), path)


def test_an_index_of_few_vectors(spark, tmp_path):
    path = str(tmp_path / "index")
    vectorindex.build(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA), path)
    vectorindex.upsert(spark.createDataFrame([(1, [0.0, 1.0]), (2, [-1.0, 0.0])], SCHEMA), path)
    assert found(spark, path, [(0, [0.0, 2.0])], 3)[0] == {0: [1, 2]}
