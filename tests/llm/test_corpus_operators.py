"""The training-data operators against brute force on small inputs, with the odd rows that a corpus has."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import components, decontaminate, html, langid, linededup, neardup, packing, quality, sharding, suffixdedup, topk
from alphaloom.llm.common import text_key
from tests_llm_brute import brute_components, brute_decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, names that clash with the operators' own columns."""
    rows = [(1, None), (2, ""), (None, "some words here\nand more words here"), (3, "x" * 30_000), (4, "same\nline\nsame\nline"), (4, "same\nline\nsame\nline"), (5, " \n\t "), (None, None)]
    d = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA)
    return d.withColumns({c: F.lit(7) for c in ("h", "n", "key", "score", "kh", "piece", "block", "size", "gone", "row_no", "features")})


def letters(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()):
    return " ".join(rng.choice(words) for _ in range(n))


# --- odd rows and empty tables: every operator gives a defined result -------------------------------------------------


def test_every_operator_takes_odd_rows(spark):
    d = odd(spark)
    assert langid.identify(d.select("doc_id", "text"), None).filter("lang_pred <> 'und'").count() == 0
    items = spark.createDataFrame([(1, None), (2, ""), (None, "same line same")], "item_id long, text string")
    dec = decontaminate.decontaminate(d, items).collect()
    assert len(dec) == 8 and sum(r["contaminated"] for r in dec) == 2  # the repeated row, twice
    near = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_dedup(d).collect()}
    assert near[None] == (None, False) and near[4] == (4, True) and near[1] == (1, True)
    assert sharding.shard(d).count() == 8
    lines = linededup.line_dedup(d)
    assert lines.count() == 8 and set(d.columns) <= set(lines.columns)
    out = suffixdedup.suffix_dedup(d).collect()
    assert len(out) == 8 and {r["doc_id"]: len(r["kept"]) for r in out}[3] == 0  # one letter 30,000 times
    assert packing.pack(d, 16).count() == 8
    assert quality.score(d, None).filter("score = 0.5").count() == 8


def test_sharding_keeps_the_type_of_ids(spark):
    d = spark.createDataFrame([("a-1", "x"), ("b", None), (None, "x"), ("a-1", "x")], "doc_id string, text string")
    out = sharding.shard(d, 2).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["None", "a-1", "a-1", "b"] and sorted((r["shard"], r["slot"]) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_every_walk_ends(spark):
    for n in (1, 2, 63, 64, 65, 4097, 10_007, 999_983, 10**9 + 7, 10**12 + 39):
        a, b = sharding.grid(n)
        assert 0 <= a * b - n <= sharding.WALK and a < 20 * n**0.5 + 65
    for n in (1, 2, 97, 4099):
        got = spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_every_operator_takes_an_empty_table(spark):
    d = docs(spark, ["x"]).limit(0)
    assert langid.train(d) is None and langid.identify(d, None).count() == 0
    assert decontaminate.decontaminate(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert neardup.near_dedup(d).count() == 0 and sharding.shard(d).count() == 0
    assert linededup.line_dedup(d).count() == 0 and suffixdedup.suffix_dedup(d).count() == 0 and packing.pack(d).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert quality.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- language identification -----------------------------------------------------------------------------------------


def test_network_gradients_are_right():
    rng = np.random.default_rng(1)
    net = langid.ByteGRU(["a", "b"], hidden=3)
    x, y, valid = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.arange(6)[:, None] < np.array([6, 6, 4, 2])
    _, g = net.gradients(x, y, valid)
    for name, at in (("Ef", (1, 2)), ("Eb", (4, 3)), ("Uf", (0, 1)), ("Ub", (5, 2)), ("W", (1, 4)), ("c", (0, 0))):
        eps, old = 1e-2, net.p[name][at]
        net.p[name][at] = old + eps
        up = net.gradients(x, y, valid)[0]
        net.p[name][at] = old - eps
        down = net.gradients(x, y, valid)[0]
        net.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=0.05, abs=2e-4)


def test_held_out_languages(spark, tiny):
    d = spark.read.parquet(tiny + "/documents.parquet")
    out = langid.identify(d.select("doc_id", "text", "lang"), langid.train(d)).withColumn("held_out", langid.held_out()).toPandas()
    ho = out[out.held_out]
    assert len(ho) > 20 and (ho.lang == ho.lang_pred).mean() >= 0.9 and out.score.between(0, 1).all()


def test_windows_cover_every_byte_once_and_see_their_margins():
    offs = np.array([0, 0, 5, 200, 500])
    data = (np.arange(500) % 250 + 1).astype(np.uint8)
    at, doc = langid.windows(offs)
    x, inside = langid.gathered(data, offs, at, doc)
    core = x[langid.MARGIN : langid.MARGIN + langid.CORE]
    assert np.array_equal(core.T[inside.T], data) and inside.sum() == 500
    assert (x[: langid.MARGIN, 2] == data[at[2] - langid.MARGIN : at[2]]).all() and (x[: langid.MARGIN, 1] == 0).all()


def test_only_letters_make_a_text(spark):
    texts = ["½ ² Ⅷ ①", "1234 !?", "a", "日", "ª"]
    net = langid.ByteGRU(["x", "y"])
    got = [r["lang_pred"] for r in langid.identify(docs(spark, texts).select("doc_id", "text"), net).orderBy("doc_id").collect()]
    assert [g == "und" for g in got] == [True, True, False, False, False]


# --- HTML ------------------------------------------------------------------------------------------------------------


def test_article_without_its_surroundings(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body><header>Site name</header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site</div><article><h1>Head&amp;line</h1><p>One <b>two</b>&nbsp;three<p>four &lt;five&gt;
    <aside>Related stuff</aside><form><label>Mail</label><input></form><div id=comments><p>A reader says a lot of words here</p></div></article><div class="sidebar"><p>More from us</p></div><footer>&copy; us</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>plain 1 &lt 2 text &am"), (5, "u", "<article><p>a<br>b</article>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(rows).collect()}
    assert got[1] == "Head&line\nOne two three\nfour <five>" and got[2] == "" == got[3] and got[5] == "a b"


LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco"


LONGER = " ".join([LONG] * 5)


@pytest.mark.parametrize(("page", "want"), [
    ("<article><h1>T</h1><p>{L}</p><p>{L}</p><div class='comments'><p>{C}</p><p>{C}</p></div></article>", "T\n{L}\n{L}"),
    ("<div class=page><div id=content><h1>T</h1><p>{L}</p><p>{L}</p></div><section id='comments'><p>{C}</p><p>{C}</p><p>{C}</p></section></div>", "T\n{L}\n{L}"),
    ("<div><h2>T</h2><p>{L}</p><div class='advertisement'><p>{C}</p></div><p>{L}</p><p>{L}</p></div>", "T\n{L}\n{L}\n{L}"),
    ("<div class=wrap><div id='content'><p>{L}</p><p>{L}</p></div><div class='sidebar'><p>{C}</p></div></div>", "{L}\n{L}"),
    ("<div class='page-with-sidebar'><div class='text'><p>{L}</p><p>{L}</p><p>Short one</p></div></div>", "{L}\n{L}\nShort one"),
    ("<div><div class='sponsored'><p>{C}</p></div><div><h1>T</h1><div>{L}</div><div>{L}</div></div><div class='cookie-notice'><p>{C}</p><button>OK</button></div></div>", "T\n{L}\n{L}"),
    ("<main><h1>T</h1><p>{L}</p><p>{L}</p><ol class='comment-list'><li><p>{C}</p></li><li><p>{C}</p></li></ol></main>", "T\n{L}\n{L}"),
    ("<table><tr><td class='nav-menu'><p>{C}</p></td><td><h1>T</h1><p>{L}</p><p>{L}</p></td></tr></table>", "T\n{L}\n{L}"),
    ("<div id='post'><h1>T</h1><p>{L}</p><p>{L}</p></div><div id='disqus'><div><p>{C}</p></div><div><p>{C}</p></div></div>", "T\n{L}\n{L}"),
    ("<div class='header-banner main-wrap'><h1>T</h1><p>{L}</p><p>{L}</p><div class='related'><p>{L}</p></div></div>", "T\n{L}\n{L}"),
])
def test_long_parts_beside_the_article(page, want):
    assert html.main_text("<html><body>" + page.format(L=LONG, C=LONGER) + "</body></html>") == want.format(L=LONG)


@pytest.mark.parametrize(("page", "want"), [
    ("<nav><a href=/>Home</a><a>News</a></nav><article><h1>Title here</h1><p>{L}</p><p class='advert'>Buy our new shoes now for less</p><p>{L}</p><p>Short one.</p></article>", "Title here\n{L}\n{L}\nShort one."),
    ("<main><h1>Title</h1><p>{L}</p><p>{L}</p><p>{L}</p><article class='comment'><p>I liked this text a lot thanks</p></article><div role=article class=comment><p>Me too it was good to read</p></div></main>", "Title\n{L}\n{L}\n{L}"),
    ("<div class='menu'><a>Home</a> <a>About</a></div><div class='layout has-sidebar'><h1>Big title</h1><p>{L}</p><p>{L}</p><p>End.</p></div><div class='footer'>Copyright us 2020</div>", "Big title\n{L}\n{L}\nEnd."),
    ("<div class='post content share-count'><h1>Big title</h1><p>{L}</p><p>{L}</p><p>End.</p></div>", "Big title\n{L}\n{L}\nEnd."),
    ("<article><h1>T</h1><p>{L}</p><p style='display:none'>Secret words here</p><div aria-hidden=true>Also hidden</div><p>{L}</p></article>", "T\n{L}\n{L}"),
    ("<article><h1>T</h1><p>{L}</p><p><a href=1>one <a href=2>two</p><p>{L}</p><p>{L}</p></article>", "T\n{L}\none two\n{L}\n{L}"),
    ("<div><a>Home News Sport Weather Shop Mail Help</a></div><div><h1>Real title</h1><p>{L}</p><p>{L}</p></div>", "Real title\n{L}\n{L}"),
    ("<table><tr><td><a>Home</a></td><td><a>News</a></td></tr><tr><td><div><h2>Head</h2><p>{L}</p><p>{L}</p></div></td></tr><tr><td>Copyright 2020 all rights</td></tr></table>", "Head\n{L}\n{L}"),
    ("<div id=top>Site name and slogan</div><div><div>Main story headline</div><div>{L}</div><div>{L}</div><div>Two words</div></div><div>Contact us by mail</div>", "Main story headline\n{L}\n{L}\nTwo words"),
    ("<header><h1>Site</h1></header><div><section><h2>A</h2><p>{L}</p></section><section><h2>B</h2><p>{L}</p><p>{L}</p></section></div><footer>bye</footer>", "A\n{L}\nB\n{L}\n{L}"),
    ("<p>Five words are right here</p><p>Two words</p>", "Five words are right here\nTwo words"),
    ("<article><header><h1>Head line</h1><p>By someone today</p></header><p>{L}</p><p>{L}</p></article>", "Head line\nBy someone today\n{L}\n{L}"),
    ("<article><h1>T</h1><p>{L}</p><p>{L}</p></article><div id=comments><p>{L}</p><p>I liked this text</p></div>", "T\n{L}\n{L}"),
    ("<article><h1>T</h1><p>{L}</p><form><p>Sign up for our letter</p><input></form><p>{L}</p><div class='related'><h3>More</h3><ul><li><a>one more text</a></li></ul></div></article>", "T\n{L}\n{L}"),
])
def test_templates_without_marks_or_with_misleading_ones(page, want):
    assert html.main_text("<html><body>" + page.format(L=LONG) + "</body></html>") == want.format(L=LONG)


def test_very_long_pages_and_odd_columns(spark):
    page = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(3000)) + "</article>"
    rows = spark.createDataFrame([(1, "u", page, "x", 5), (1, "u", page, "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    out = html.extract(rows).collect()
    assert len(out) == 2 and out[0] == out[1] and out[0]["n_chars"] == len(out[0]["text"]) and out[0]["text"].count("\n") == 2999


def test_tree_fits_its_table():
    rows = np.array([line.split() for line in html.LABELLED.strip().splitlines()], float)
    assert (html.classify(html.trained(), rows[:, :-1]) == rows[:, -1]).all()


def test_pages_of_the_table(spark, tiny):
    import html as h

    src = spark.read.parquet(tiny + "/pages.parquet").toPandas().set_index("page_id").html
    for r in html.op2_html_extraction(spark, tiny).collect():
        inside = re.search(r"<article>(.*)</article>", src[r["page_id"]], re.S)[1]
        parts = (" ".join(h.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# --- decontamination -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(5)
    items = [(i, letters(rng, n)) for i, n in enumerate((30, 13, 12, 5, 2, 1, 0, 20))] + [(99, "É tÉ İX"), (100, None)]
    texts = [letters(rng, 60) for _ in range(30)] + [letters(rng, 9) + " " + items[0][1].upper() + "! " + letters(rng, 400), items[1][1] * 2, "é té ix", "É-TÉ.İx", None, "", items[7][1].replace(" ", ", ")]
    got = decontaminate.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: tuple(r[1:6]) for r in got.collect()} == brute_decontaminate(texts, items)


# --- near-duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_brute_force(spark, k):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((40, 90, 160)))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(12):  # families of edits, some of which fall below the threshold against each other
            t = list(b)
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += ["one", "One", "one two", None, "", "  "]
    rng.shuffle(texts)
    got = {r["doc_id"]: tuple(r[1:4]) for r in neardup.near_dedup(docs(spark, texts), k=k).collect()}
    assert got == brute_components(texts, k)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (102, 102), (101, 100)]
    got = dict(components.components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


# --- top-k -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k_brute_force(spark, block):
    rng = np.random.default_rng(4)
    v = np.round(rng.standard_normal((120, 6)) * 2) / 4
    v[30:70] = v[30]  # a third are one vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (250, [float("inf")]), (300, []), (None, [1.0]), (350, [0.5])]
    q = np.floor(256 * np.vstack([v, np.zeros((1, 6)), [[0.5] + [0.0] * 5]])).astype(int)
    ids, want = [*range(120), 300, 350], set()
    for a, i in enumerate(ids):
        if i % 50 == 0:
            order = sorted((-int(q[a] @ q[b]), j) for b, j in enumerate(ids) if j != i)[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(order)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), roots=4, block=block, asked_in_slice=2)
    assert {tuple(r) for r in got.collect()} == want


def test_top_k_of_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 5.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"] >> 16) for r in got) == [(1, 1, 3), (1, 1, 5), (2, 2, 1), (2, 2, 2)]
    rows = [(0, [1e8, 3.0]), (1, [1e8, -1e8]), (2, [1.0, 1.0]), (3, [1e300, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    x = 256 * 10**8
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, 256 * x + 256 * 768)] and x * x - 768 * x > 2**63


def test_tree_skips_distances():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    tree, limits = topk.MTree(x, page=64), np.full(2, np.inf)

    def offer(rows, who):
        for w in who:
            limits[w] = min(limits[w], np.sqrt(((x[rows] - x[5 + w]) ** 2).sum(axis=1)).min())

    assert tree.search(x[5:7], limits, offer) < 3000 and (limits == 0).all()


# --- sharding --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation_is_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def test_shards_follow_the_law_at_any_partitioning(spark, tiny):
    d = spark.read.parquet(tiny + "/documents.parquet")
    a, b = (sharding.shard(x).orderBy("doc_id").collect() for x in (d, d.repartition(7)))
    assert a == b
    count = Counter(r["shard"] for r in a)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(16))
    assert all(sorted(r["slot"] for r in a if r["shard"] == s) == list(range(n)) for s, n in count.items())


# --- quality ---------------------------------------------------------------------------------------------------------


def test_held_out_quality(spark, tiny):
    d, lab = spark.read.parquet(tiny.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(tiny.replace("0.001", "0.01") + "/labels.parquet")
    out = quality.score(d.select("doc_id", "text"), quality.train(d, lab)).withColumn("held_out", quality.held_out()).join(lab, "doc_id").toPandas()
    ho = out[out.held_out]
    assert len(ho) > 30 and (ho.predicted == ho.quality).mean() >= 0.93 and out.score.between(0, 1).all()


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    m = quality.AdditiveModel().fit(x, y, rounds=60)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and m.pairs[0] == (1, 0)


# --- line dedup ------------------------------------------------------------------------------------------------------


def test_shared_passages_go_whole(spark):
    rng = random.Random(9)
    shared = [letters(rng, 6) for _ in range(3)]
    texts = ["\n".join([letters(rng, 5), *shared, letters(rng, 4)]) for _ in range(30)]
    out = {r["doc_id"]: r for r in linededup.line_dedup(docs(spark, texts)).collect()}
    assert sum(r["n_removed_lines"] for r in out.values()) == 87 and out[0]["text"] == texts[0]
    assert all(out[i]["text"] == "\n".join(texts[i].split("\n")[::4]) for i in range(1, 30))


# --- suffix dedup ----------------------------------------------------------------------------------------------------


def brute_spans(texts, m):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + m] for b in raw for i in range(len(b) - m + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - m + 1):
            if count[b[i : i + m]] > 1:
                gone[i : i + m] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        out.append(([(int(a), int(z)) for a, z in zip(edge[::2], edge[1::2], strict=True)], bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


@pytest.mark.parametrize(("match", "gram", "bucket"), [(200, 40, 20_000), (200, 40, 2), (30, 8, 20_000)])
def test_suffix_dedup_brute_force(spark, match, gram, bucket):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdé ") for _ in range(700))
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(900))) for _ in range(12)]
    for _ in range(12):
        a, n = rng.randrange(500), rng.choice((150, 199, 200, 201, 260, 700))
        texts.append("".join(rng.choice("abcd ") for _ in range(rng.randrange(80))) + passage[a : a + n] + "".join(rng.choice("abcd ") for _ in range(rng.randrange(300))))
    texts += [None, "", "z" * 450, "ab" * 300, texts[0], texts[0], "q" * 199]
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffixdedup.suffix_dedup(docs(spark, texts), match, gram, bucket).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, match)


@pytest.mark.parametrize("n", [2, 13, 200, 600])
def test_reaches_brute_force(n):
    rng = random.Random(n)
    passage, before, after = bytes(rng.choice(b"abcd") for _ in range(400)), [], []
    for _ in range(n):
        before.append((bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) + passage[200 - rng.randrange(160) : 200])[::-1])
        after.append(passage[200 : 200 + rng.randrange(40, 200)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))))
    # next to a bucket of other strings and one of a single place
    other = [bytes(rng.choice(b"xy") for _ in range(60)) for _ in range(3)] + [before[0]]
    left, right = suffixdedup.reaches(np.array([4] * n + [5] * 3 + [6]), before + other, after + other[:3] + [after[0]])
    assert (left[n:] == -1).all() and (right[n:] == -1).all()
    for i in range(0, n, max(1, n // 40)):
        good = [(x, y) for j in range(n) if j != i and (x := suffixdedup.common(before[i], before[j])) + (y := suffixdedup.common(after[i], after[j])) >= 200]
        assert (left[i], min(200, right[i])) == (max((x for x, _ in good), default=-1), min(200, max((y for _, y in good), default=-1)))


def test_deep_shallow_sorts():
    rng = random.Random(0)
    base = bytes(rng.choice(b"ab") for _ in range(150))
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(300))) for _ in range(300)] + [base + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(9))) for _ in range(200)]
    strings += [b"", b"\0", b"a", b"a\0", b"a\0\0", b"a\0b"]
    for bucket in (np.zeros(len(strings), int), np.arange(len(strings)) % 3):
        order, lcp = suffixdedup.ranked(bucket, strings)
        assert [(bucket[i], strings[i]) for i in order] == sorted(zip(bucket.tolist(), strings))
        want = [-1] + [suffixdedup.common(strings[a], strings[b]) if bucket[a] == bucket[b] else -1 for a, b in zip(order, order[1:])]
        assert lcp.tolist() == want


def test_long_texts_have_the_anchors_of_short_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffixdedup.anchors(data, np.zeros(5000, int), np.full(5000, 5000))[0]
    parts = []
    for lo, hi, a, b in suffixdedup._pieces(np.array([0, 5000]), 700, 400):
        at = suffixdedup.anchors(data[lo:hi], np.zeros(hi - lo, int), np.full(hi - lo, hi - lo))[0] + lo
        parts += [x for x in at if a <= x < b]
    assert parts == whole.tolist()


# --- packing ---------------------------------------------------------------------------------------------------------


def brute_best_fit(sizes, sources, clusters, capacity):
    free, inside, bins, starts = [], [], [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        mine = {("s", s)} if s is not None else set()
        mine |= {("c", c)} if c is not None else set()
        ok = [(free[b], b) for b in range(len(free)) if free[b] >= n and not inside[b] & mine]
        b = min(ok)[1] if ok else len(free)
        if not ok:
            free.append(capacity)
            inside.append(set())
        bins.append(b)
        starts.append(capacity - free[b])
        free[b] -= n
        inside[b] |= mine
    return bins, starts


def test_best_fit_brute_force():
    rng = random.Random(3)
    n = 400
    sizes = sorted((rng.randrange(1, 100) for _ in range(n)), reverse=True)
    sources = [rng.choice(["a"] * 9 + list("bcdefghij") + [None]) for _ in range(n)]
    clusters = [rng.choice([1] * 4 + list(range(2, 300)) + [None]) for _ in range(n)]
    assert packing.best_fit(sizes, sources, clusters, 100) == brute_best_fit(sizes, sources, clusters, 100)


def test_bins_hold_their_pieces(spark):
    rng = random.Random(6)
    d = docs(spark, [letters(rng, rng.choice((1, 5, 40, 70, 300))) for _ in range(200)] + [None, "", "x"]).withColumn("cluster", text_key())
    out = packing.pack(d, 64, block=50).join(d.select("doc_id", "source", "cluster", "text"), "doc_id").toPandas()
    words = out.groupby("doc_id").n_words.sum()
    assert all(words[i] == max(1, len((t or "").split())) for i, t in out.drop_duplicates("doc_id").set_index("doc_id").text.items())
    for _, g in out.sort_values("start").groupby(["block", "bin"]):
        assert g.n_words.sum() <= 64 and g.start.tolist() == [0, *np.cumsum(g.n_words)[:-1]] and g.source.is_unique and g.cluster.is_unique
    assert (out.groupby("block").size() <= 50).all()
