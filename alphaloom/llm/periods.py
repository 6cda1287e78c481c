"""Periodic runs of words: maximal stretches that repeat with a period at least four times.

Per document, many documents of a chunk at once:

1. a harmonic grid proposes: for each period p the places 0, p, 2p, ... of a document are compared with the places p words on.
   A run of period p and ``least(p) = max(6, 4p)`` words or more holds a grid place in its first p words, from which at least
   ``least(p) - 2p + 1 >= 5`` words must agree with those p words on, so pairs that differ in their first ``DIRECT`` words go at once;
2. the rest ask for longest common extensions (LCE). Of all suffixes only those at places of a difference cover modulo ``V``
   are sorted: two places reach cover places after the same few words, which are compared one by one; beyond these the
   least value of the common prefix lengths between the two ranks answers, from a sparse table. Only documents with a
   pair left from step 1 are sorted;
3. the start of a run follows by bisection over the same extensions, less than p words back; stretches that multiples of their period propose
   are kept once, with the least period.

No step crosses documents, so a task needs one chunk of whole documents, ``CHUNK`` words or one document if that is longer.

Defined results: a null or blank text has no words and no runs; repeated rows get a result each; a null id leaves the words as they
are (see ``planted``); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import table

#: A perfect difference set: every difference modulo V is one of two members.
V, COVER = 13, (0, 1, 3, 9)
DIRECT, CHUNK, PAIRS = 4, 400_000, 4_000_000

# SHIFT[a, b]: the fewest words after which places of residues a and b are both in the cover.
_IN = np.isin(np.arange(V), COVER)
SHIFT = np.array([[next(d for d in range(V) if _IN[(a + d) % V] and _IN[(b + d) % V]) for b in range(V)] for a in range(V)])


def least(p: np.ndarray | int) -> np.ndarray:
    """Words that a run of period p needs."""
    return np.maximum(6, 4 * np.asarray(p))


class Extensions:
    """Longest common extensions of places in ``ids``; no two equal stretches reach beyond a document if each ends in an id of its own."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        # V places of padding, ids below all others, so that blocks and direct comparisons need no bounds
        self.ids = np.concatenate([ids, -1 - np.arange(2 * V, dtype=ids.dtype)])
        self.places = np.flatnonzero(_IN[np.arange(n + V) % V])
        self.at = np.full(len(self.ids) + V, -1, np.int64)
        self.at[self.places] = np.arange(len(self.places))
        rank, blocks = self._sorted()
        self.rank = rank
        self.table = self._sparse(self._common(blocks))

    def _sorted(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ranks of the cover suffixes, and their classes by the first V, 2V, 4V, ... words."""
        m, end = len(self.places), len(self.ids)
        columns = [self.ids[np.minimum(self.places + j, end - 1)] for j in range(V)]
        name, levels, width = _classes(columns), [], V
        while True:
            levels.append(name)
            if int(name.max(initial=0)) == m - 1 or width > end:
                return name, levels
            after = self.at[np.minimum(self.places + width, len(self.at) - 1)]  # a cover place again: width is a multiple of V
            name = _classes([name, np.where(after >= 0, name[after], -1)])
            width *= 2

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix in sorted order with the one before it."""
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(self.rank))
        a, b = order[:-1].copy(), order[1:].copy()
        total, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(len(levels) - 1, -1, -1):
            width = V << k
            same = open_ & (levels[k][a] == levels[k][b])
            total[same] += width
            at = np.minimum(self.places[a[same]] + width, len(self.at) - 1), np.minimum(self.places[b[same]] + width, len(self.at) - 1)
            a[same], b[same] = self.at[at[0]], self.at[at[1]]
            ended = same & ((a < 0) | (b < 0))
            open_ &= ~ended
            a[ended], b[ended] = 0, 0
        x, y, run = self.places[a], self.places[b], open_.copy()
        for j in range(V):
            run &= self.ids[np.minimum(x + j, len(self.ids) - 1)] == self.ids[np.minimum(y + j, len(self.ids) - 1)]
            total[run] += 1
        return total

    @staticmethod
    def _sparse(lcp: np.ndarray) -> list[np.ndarray]:
        """Least values of 1, 2, 4, ... neighbours."""
        rows = [lcp.astype(np.int32)]
        while 2 ** len(rows) <= len(lcp):
            half = 2 ** (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        return rows

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from each place of ``a`` and the place of ``b`` (a differs from b) on."""
        out = np.zeros(len(a), np.int64)
        shift, run = SHIFT[a % V, b % V], np.ones(len(a), bool)
        for j in range(int(shift.max(initial=0))):
            run &= (j >= shift) | (self.ids[a + j] == self.ids[b + j])
            out[run & (j < shift)] += 1
        x, y = self.rank[self.at[a[run] + shift[run]]], self.rank[self.at[b[run] + shift[run]]]
        lo, size = np.minimum(x, y), np.abs(x - y)
        level = np.frexp(size.astype(np.float64))[1] - 1
        got = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            got[at] = np.minimum(self.table[k][lo[at]], self.table[k][lo[at] + size[at] - (1 << k)])
        out[run] += got
        return out


def _classes(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _grid(sizes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every grid pair of documents with these sizes and first places, at most about PAIRS at a time."""
    docs = np.flatnonzero(sizes >= 6)
    if not len(docs):
        return
    top = np.maximum(1, sizes[docs] // 4)
    places, periods, held = [], [], 0
    for p in range(1, int(top.max()) + 1):
        docs = docs[np.maximum(1, sizes[docs] // 4) >= p]
        # the last place from which enough words can agree
        count = np.maximum(0, (sizes[docs] - p - (int(least(p)) - 2 * p + 1)) // p + 1)
        total = int(count.sum())
        if not total:
            continue
        first = np.cumsum(count) - count
        places.append(np.repeat(begin[docs] - first * p, count) + np.arange(total) * p)
        periods.append(np.full(total, p))
        held += total
        if held >= PAIRS:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _first_places(ext: Extensions, at: np.ndarray, p: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs by document, period and place: those that no earlier pair's stretch covers, and how far they agree.

    A stretch that starts beyond the first word that breaks the one before it is found from a later place, so places up to
    that word are passed over: a document of one repeated word asks once a period.
    """
    head = np.ones(len(at), bool)
    head[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    group = np.cumsum(head) - 1
    size = len(ext.ids)
    key = group * size + at
    ends = np.append(np.flatnonzero(head)[1:], len(at))
    now, out = np.flatnonzero(head), []
    while len(now):
        ahead = ext.lce(at[now] + DIRECT, at[now] + p[now] + DIRECT) + DIRECT
        out.append((now, ahead))
        after = np.searchsorted(key, key[now] + ahead + 1)
        now = after[after < ends[group[now]]]
    now, ahead = (np.concatenate(x) for x in zip(*out, strict=True))
    return at[now], p[now], doc[now], ahead


def runs_of(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, by document, start and period; ``ids``: words of all documents on end."""
    none = np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    # every document ends in an id of its own
    closed = np.empty(len(ids) + len(sizes), np.int64)
    last = begin + sizes + np.arange(len(sizes))
    closed[np.setdiff1d(np.arange(len(closed)), last, assume_unique=True)] = ids
    closed[last] = int(ids.max(initial=0)) + 1 + np.arange(len(sizes))
    begin = begin + np.arange(len(sizes))

    left = []
    for at, p in _grid(sizes, begin):
        for j in range(DIRECT):  # most pairs differ in their first word
            same = closed[at + j] == closed[at + p + j]
            at, p = at[same], p[same]
        left.append((at.astype(np.int32), p.astype(np.int32)))
    at, p = (np.concatenate(x) for x in zip(*left, strict=True)) if left else (none, none)
    if not len(at):
        return none, none, none, none
    # sort the cover suffixes of the documents that are still asked about
    at, p = at.astype(np.int64), p.astype(np.int64)
    doc = np.searchsorted(begin, at, "right") - 1
    asked = np.unique(doc)
    width = sizes[asked] + 1
    moved = np.cumsum(width) - width
    take = np.repeat(begin[asked] - moved, width) + np.arange(int(width.sum()))
    near = np.searchsorted(asked, doc)
    at += moved[near] - begin[doc]
    ext = Extensions(closed[take])
    order = np.lexsort((at, p, near))
    at, p, near = at[order], p[order], near[order]
    at, p, near, ahead = _first_places(ext, at, p, near)
    good = ahead >= least(p) - 2 * p + 1
    at, p, ahead, first, own = at[good], p[good], ahead[good], moved[near[good]], asked[near[good]]
    # words before the place that agree too, up to p of them: a place p words earlier has the run otherwise
    lo, hi = np.zeros(len(at), np.int64), np.minimum(p, at - first)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        ask = lo < hi
        enough = np.zeros(len(at), bool)
        enough[ask] = ext.lce(at[ask] - mid[ask], at[ask] - mid[ask] + p[ask]) >= mid[ask]
        lo, hi = np.where(ask & enough, mid, lo), np.where(ask & ~enough, mid - 1, hi)
    start, length = at - lo - first, p + ahead + lo
    good = (lo < p) & (length >= least(p))
    own, start, length, p = own[good], start[good], length[good], p[good]
    order = np.lexsort((p, length, start, own))  # equal stretches: the least period is the smallest one
    own, start, length, p = own[order], start[order], length[order], p[order]
    once = np.ones(len(own), bool)
    once[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    own, start, length, p = own[once], start[once], length[once], p[once]
    order = np.lexsort((p, start, own))
    return own[order], start[order], length[order], p[order]


def planted(n: int, doc_id: object) -> np.ndarray | None:
    """Which word stands at each of ``n`` places once the tail of a tenth of the documents is made periodic; None: no change."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _chunks(column: pa.Array, ids: list, plant: bool) -> Iterator[list[list[bytes]]]:
    """Lists of documents as words, about CHUNK words at a time."""
    held, total = [], 0
    for text, doc_id in zip(column, ids, strict=True):
        words = (text.as_py() or "").encode().split()  # bytes are split at ASCII white space only
        way = planted(len(words), doc_id) if plant else None
        if way is not None:
            words = [words[i] for i in way.tolist()]
        if held and total + len(words) > CHUNK:
            yield held
            held, total = [], 0
        held.append(words)
        total += len(words)
    if held:
        yield held


def detect(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, runs, collapsed) of every row.

    ``start``, ``length``, ``period``: the run of the greatest length/period (ties: smallest start, then period), null without runs;
    ``runs``: all runs by start, then period; ``collapsed``: the words that no run holds after its first period, joined by a space.
    ``plant``: first make tails periodic by the law of ``planted``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = "n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in _chunks(batch.column("text"), batch.column("doc_id").to_pylist(), plant):
                sizes = np.array([len(x) for x in chunk], np.int64)
                words = pa.array([w for doc in chunk for w in doc], pa.binary()).dictionary_encode()
                own, start, length, period = runs_of(words.indices.to_numpy().astype(np.int64), sizes)
                edge = np.searchsorted(own, np.arange(len(chunk) + 1))
                rows: dict[str, list] = {k: [] for k in ("n", "s", "l", "p", "runs", "kept")}
                for k, doc in enumerate(chunk):
                    mine = slice(edge[k], edge[k + 1])
                    found = list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
                    s, l, p = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                    if found:
                        change = np.zeros(len(doc) + 1, np.int64)
                        for x, size, q in found:
                            change[x + q] += 1
                            change[x + size] -= 1
                        keep = np.cumsum(change[:-1]) == 0
                        doc = [w for w, stays in zip(doc, keep.tolist(), strict=True) if stays]
                    for key, value in zip(rows, (len(found), s, l, p, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(doc)), strict=True):
                        rows[key].append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(run), pa.binary())
                columns = [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(chunk)), *columns], names=["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"])
                done += len(chunk)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, f"doc_id {kind}, {fields}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"), plant=True)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", F.call_function("div", F.lit(1000).cast("long") * F.col("length"), F.col("period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, b:
 list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, CAST(3988292384 AS UBIGINT)) ELSE s >> 1 END)), CAST(4294967295 AS UBIGINT)) AS BIGINT)"""

#: Pairs of equal five-word strings, islands of consecutive places a period.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
law AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, len(w) AS n FROM d),
tail AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM law),
word AS MATERIALIZED (SELECT r, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM tail)),
five AS MATERIALIZED (SELECT r, n, i, concat_ws(' ', w, w1, w2, w3, w4) AS k FROM (SELECT *, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM word WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE w4 IS NOT NULL),
pair AS (SELECT x.r, x.i, y.i - x.i AS p FROM five x JOIN five y ON x.r = y.r AND x.k = y.k AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT r, p, min(i) AS start, max(i) + 5 + p - min(i) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM pair) GROUP BY r, p, g HAVING length >= greatest(6, 4 * p)),
run AS MATERIALIZED (SELECT r, start, length, min(p) AS period FROM stretch GROUP BY r, start, length),
best AS (SELECT r, start, length, period FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM run GROUP BY r),
cut AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, sha256(string_agg(w, ' ' ORDER BY i)) AS s FROM word ANTI JOIN cut USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
 coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(s, sha256('')) AS collapsed_sha256 FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
