"""Links at the threshold of 0.8 whose signatures agree less than most do, and groups that need every comparison."""

import numpy as np

from alphaloom.llm import neardup
from tests_llm_brute import brute_components


def test_a_link_with_few_equal_minima(spark):
    """Two texts of 45 words with 40 of 50 in common: a pair at the threshold."""
    at = np.random.default_rng(1404).permutation(2000)[:50]
    texts = [" ".join(f"w{i}" for i in ix) for ix in (at[:45], np.concatenate([at[:40], at[45:]]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x, y = (np.frombuffer(r["low"], np.uint8) for r in neardup.signed(docs, 1).orderBy("doc_id").collect())
    assert 0.6 < (x == y).mean() < 0.66
    assert {r["component_id"] for r in neardup.near_dedup(docs, k=1).collect()} == {0}


def spread_group(n=160, words=60, seed=3):
    """Copies of one text with more or fewer words replaced: links, and many pairs a little under 0.8."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.permutation(words)[: rng.integers(0, 12)]:
            w[i] = f"x{rng.integers(40)}"
        out.append(" ".join(w))
    return out


def test_a_group_around_the_threshold_in_small_blocks(spark, monkeypatch):
    texts = spread_group() + [" ".join(f"o{j}w{i}" for i in range(30)) for j in range(20)]
    want = brute_components(texts, 1)
    assert len({w[1] for w in want.values()}) > 25
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (neardup.BLOCK, 600):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_dedup(docs, k=1).collect()}
        assert got == want


def test_an_id_with_two_texts_names_two_documents(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a)]
    out = neardup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["h"], r["component_id"], r["kept"]) for r in out.collect())
    assert [(g[0], g[2], g[3]) for g in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]
    assert len({g[1] for g in got if g[3]}) == 2


def test_block_joins_each_component_once():
    sets = [np.arange(10, dtype=np.uint64), np.arange(11, dtype=np.uint64), np.arange(500, 510, dtype=np.uint64)]
    block = neardup.Block([7, 8, 9], [bytes(128)] * 3, sets, 80)
    assert block.shared(np.arange(5, 505, dtype=np.uint64), np.arange(3)).tolist() == [5, 6, 5]
    wide = neardup.Block(list(range(6)), [bytes(128)] * 6, [sets[0]] * 6, 80)
    assert wide.shared(sets[1], np.arange(6)).tolist() == [10] * 6
