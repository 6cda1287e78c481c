"""Whole repeated runs of lines against brute force."""

import random

import pytest

from alphaloom.llm import linededup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def brute_runs(texts):
    seen, out = {}, []
    for d, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for i in range(len(lines) - 1):
            f, at = seen.setdefault((lines[i], lines[i + 1]), (d, i))
            if f != d or i > at + 1:
                gone |= {i, i + 1}
        out.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def texts_with_runs():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(7))
    runs = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 7, 12)]
    texts = []
    for _ in range(40):
        parts = [[line() for _ in range(rng.randrange(1, 4))]]
        for r in rng.sample(runs, 2):
            parts += [r, [line() for _ in range(rng.randrange(1, 3))]]
        texts.append("\n".join(x for p in parts for x in p))
    return runs, texts + [texts[0], texts[5], None, "", "a", "a", "b\nb\nb", "b\nb\nb\nb\nb", "\n\n\n\n", "a\nc\na\nc\na"]


@pytest.mark.parametrize("divisor", [1, 4, 1_000_003])
def test_line_dedup_brute_force(spark, divisor):
    _, texts = texts_with_runs()
    out = linededup.line_dedup(docs(spark, texts), divisor).collect()
    want = brute_runs(texts)
    assert {r["doc_id"]: r["text"] for r in out if r["n_removed_lines"] < r["n_lines"]} == {i: t for i, t in enumerate(want) if t or texts[i] == ""}
    assert {r["doc_id"] for r in out if 0 < r["n_lines"] == r["n_removed_lines"]} == {i for i, t in enumerate(want) if texts[i] and not t}


def test_the_stage_leaves_no_repeated_run(spark, tiny):
    runs, texts = texts_with_runs()
    out = [r["text"] or "" for r in corpus_pipeline.lines(spark, docs(spark, texts), tiny).orderBy("doc_id").collect()]
    for r in runs:
        assert sum("\n".join(r) in t for t in out) == 1  # its first place
        assert sum(x in t.split("\n") for t in out for x in r) == len(r)  # no fragment elsewhere
