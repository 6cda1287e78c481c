"""Chat formatting, periodic runs and centroid clustering against brute force, with odd rows and empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alphaloom.llm import centroids, chat, periods

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- chat ------------------------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["<", ">", "<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[INST", "\\", "<<", ">>", "a", " ", "\n", "é", "[", "/INST]"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=6))
def test_template_is_reversible(turns):
    text, spans = chat.format_turns(turns)
    assert chat.read_back(text) == turns
    assert chat.under_mask(text, spans) == "".join(t for r, t in turns if r == "assistant")
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        assert all(control not in chat.escape(t) for _, t in turns)


def brute_paths(rows, top):
    parent, score = {}, {}
    for t, n, p, s in rows:
        k = (t, n)
        if p is not None:
            parent[k] = min(p, parent.get(k, p))
        score[k] = max(s if s is not None else -1e9, score.get(k, -1e9))
    score = {k: 0.0 if v == -1e9 else v for k, v in score.items()}
    up = {k: (k[0], parent[k]) for k in score if k in parent and parent[k] != k[1] and (k[0], parent[k]) in score}
    out = {}
    for leaf in set(score) - set(up.values()):
        path = [leaf]
        while path[-1] in up and len(path) <= len(score):
            path.append(up[path[-1]])
        if len(path) <= len(score):
            out.setdefault(leaf[0], []).append((-sum(score[k] for k in path) / len(path), leaf[1], [k[1] for k in reversed(path)]))
    return {(t, r + 1): p[2] for t, ps in out.items() for r, p in enumerate(sorted(ps, key=lambda x: (round(x[0], 9), x[1]))[:top])}


def test_reply_paths_brute_force(spark):
    rng, rows = random.Random(5), []
    for tree in (1, 2, 3, 4, None):
        for n in range(40 if tree != 2 else 1):
            rows.append((tree, n, None if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - (3 if tree == 1 else 40)), n), float(rng.randrange(5))))
    rows += [(5, i, i - 1 if i else None, None) for i in range(300)]  # one long chain
    rows += [(6, 0, 1, 1.0), (6, 1, 0, 1.0), (6, 2, 1, 1.0), (6, 3, 3, 1.0), (6, 4, 99, 1.0), (6, 5, 4, 1.0)]  # a cycle, a leaf below it, a loop, an absent parent
    rows += [(1, 3, 2, 9.0), (1, 3, 2, 9.0)]  # repeated ids
    links = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for r in chat.reply_paths(links, 3).orderBy("position").collect():
        got.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    assert got == brute_paths(rows, 3)


def test_chat_samples_and_odd_rows(spark):
    rows = [(1, 1, None, "user", "ask", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good</s>", 5.0), (1, 4, 3, None, None, 5.0), (2, 7, None, "assistant", "", None)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumns({c: F.lit(1) for c in ("t2", "n2", "rank", "leaf", "up", "position", "formatted")})
    out = {(r["tree"], r["rank"]): r for r in chat.chat_samples(m, 2).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1)}
    assert chat.read_back(out[1, 1]["formatted"]) == [("user", "ask"), ("assistant", "good</s>"), ("", "")]
    assert out[2, 1]["formatted"] == "<s></s>" and out[2, 1]["n_turns"] == 1
    assert chat.chat_samples(m.limit(0)).count() == 0


def test_threads_take_gaps_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 5000, "assistant", "b"), (1, 9000, "user", None), (1, 9000, "user", None), (2, None, "system", "s"), (2, 3, "assistant", "x" * 100_000), (None, 1, None, "n"), (3, -5, "user", "before"), (3, 2, "assistant", "after")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links, texts = chat.threads(c)
    got = {r["tree"]: chat.read_back(r["formatted"]) for r in chat.samples(texts, chat.reply_paths(links)).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("user", ""), ("user", "")], 2: [("system", "s"), ("assistant", "x" * 100_000)], None: [("", "n")], 3: [("user", "before"), ("assistant", "after")]}
    assert chat.samples(texts.limit(0), chat.reply_paths(links.limit(0))).count() == 0


def test_op11_reads_all_conversations_back(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    out = chat.op11_chat_formatting(spark, tiny).collect()
    assert len(out) == len(want)
    for r in out:
        loss = "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(want[r["conv_id"]]), sha("".join(f"{a}\n{b}\n" for a, b in want[r["conv_id"]])))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


# --- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(w):
    out, seen = [], set()
    for p in range(1, len(w) // 4 + 1) if len(w) >= 6 else []:
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p) and (i, j + p - i) not in seen:
                seen.add((i, j + p - i))
                out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    rng = random.Random(2)
    for _ in range(250):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            d = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(rng.choice((9, 40, 160))))]
            if len(d) > 8 and rng.random() < 0.6:
                a = rng.randrange(len(d))
                d = d[:a] + [d[a + i % rng.choice((1, 2, 5, 11)) % (len(d) - a)] for i in range(len(d) - a)]
            docs.append(d * rng.choice((1, 1, 4)))
        found = periods.runs_of(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]))
        assert list(zip(*(x.tolist() for x in found), strict=True)) == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d)]


def test_extensions_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 5, 14, 200):
        ids = np.append(rng.integers(0, 2, n), 7)
        ext = periods.Extensions(ids)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a != b], b[a != b]
        want = [next(k for k in range(n + 2) if ids[min(x + k, n)] != ids[min(y + k, n)] or max(x, y) + k > n) for x, y in zip(a, b, strict=True)]
        assert ext.lce(a, b).tolist() == want


def test_detect_takes_odd_rows(spark):
    texts = [(1, None), (2, " \t\n"), (None, "a a a a a a"), (3, "x y " * 20_000), (3, "x y " * 20_000), (4, "one two three")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_runs", "start", "runs", "h")})
    got = [(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], bytes(r["collapsed"]).decode()) for r in periods.detect(d).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, None, None, None, ""), (2, 0, None, None, None, ""), (None, 1, 0, 6, 1, "a"), *[(3, 1, 0, 40_000, 2, "x y")] * 2, (4, 0, None, None, None, "one two three")], key=str)
    assert periods.detect(d.limit(0)).count() == 0


def test_op12_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in periods.op12_periodic_runs(spark, tiny).collect()}
    assert len(out) == len(docs)
    for doc_id, text in docs:
        w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w) if len(w) < 1500 else None
        if runs is None:
            continue
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        r = out[doc_id]
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)


# --- centroid clustering ---------------------------------------------------------------------------------------------


def brute_cluster(rows, k, rounds, dims):
    kept = [(i, [int(math.floor(x * 1024)) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((sha(f"3:{i}"), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), c in zip(kept, at, strict=True) if c == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((str(i), *near(v)[::-1]) for i, v in kept)), cs


@pytest.mark.parametrize("huge", [False, True])
def test_cluster_brute_force(spark, huge):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 3, 0.7) for _ in range(4)]) for i in range(80)] + [(80, [0.5] * 4), (80, [0.5] * 4), (81, None), (82, []), (83, [1.0, None, 2.0, 3.0]), (84, [1.0, float("nan"), 2.0, 3.0]), (85, [float("inf")] * 4), (None, [0.1] * 4), (86, [-0.0001, 0.0, -1.0, 1e-300])]
    if huge:
        rows += [(90, [1e30, -1e300, 1.0, 2.0]), (91, [2.0**70, 5.0, -(2.0**43) - 0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "distance", "id", "y", "first")}).repartition(3)
    want, cs = brute_cluster(rows, 5, 4, 4)
    out = centroids.cluster(df, k=5, rounds=4, dims=4).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in out) == [(i, c, d if d < 2**63 else None) for i, c, d in want]
    assert all(r["centroid"] == [str(v) for v in cs[r["cluster"]]] for r in out)
    inertia = sum(d for *_, d in want)
    assert {r["inertia"] for r in out} == {inertia if inertia < 2**63 else None}


def test_cluster_takes_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["cluster"], r["distance"]) for r in centroids.cluster(df, k=5, dims=2).collect()] == [(0, 0), (0, 0)]
    assert centroids.cluster(df.limit(0), dims=2).count() == 0 and centroids.cluster(df, dims=3).count() == 0


def test_orchard_measures_less_than_all():
    rng = np.random.default_rng(0)
    spots = rng.integers(-10_000, 10_000, (64, 8))
    x = spots[rng.integers(0, 64, 3000)] + rng.integers(-300, 300, (3000, 8))
    search = centroids.Orchard(spots.tolist())
    at, d = search.nearest(x, np.zeros(3000, np.int64))
    every = ((x[:, None] - spots[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert search.measured < 0.5 * every.size
