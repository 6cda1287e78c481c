"""Exact substring dedup by sorting suffixes at content-defined places (deep-shallow sorting).

A byte is removed if a 200-byte string covers it that also starts somewhere else in the corpus. Which suffixes need
sorting follows from content: in every 200-byte string the place with the least hash among its 40-byte strings is an
anchor, so equal 200-byte strings have their anchors at equal offsets. For an anchor only its surroundings matter, 160
bytes before and 200 after:

1. anchors whose 40 bytes occur once are dropped; where all occurrences have the same surroundings, these are shared whole;
2. otherwise the distinct surroundings of an anchor string form one bucket of a sparse suffix array, whatever their number.
   Its suffixes, and its reversed prefixes, are sorted by multikey quicksort to a shallow depth, and groups that are still
   equal there by blind tries; the orders and their common prefix lengths give the classes that share d bytes before and
   200 - d after, and so the reach of the shared strings to both sides. A task sorts many buckets in one go. Only a bucket
   beyond ``BUCKET`` surroundings, too large for a task, has its 200-byte strings counted instead, a row each, which
   spreads it over all tasks;
3. the reaches of all occurrences are joined to their documents, merged and cut out.

Hashes only propose, except that the two 64-bit hashes of an anchor string and its surroundings stand for equal ones;
strings are compared on bytes, in large buckets too.

Defined results: null texts count as empty; texts under 200 bytes keep all; rows that repeat an id and text are separate
places, so both lose what they share; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import _powers, forget, mix64, table, text_buffer, text_key, written

MATCH, GRAM, SHALLOW, BUCKET, PIECE, SORTED = 200, 40, 96, 100_000, 1 << 20, 20_000


# --- anchors ---------------------------------------------------------------------------------------------------------


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i:i+w] for every i with a full window."""
    n = len(x)
    rows = np.full(-(-n // w) * w, fill, x.dtype)
    rows[:n] = x
    rows = rows.reshape(-1, w)
    head = op.accumulate(rows, axis=1).ravel()
    tail = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of the texts in ``data``; begin/end hold, for each byte, where its text starts and ends.

    Returns positions, hashes of the anchor strings and hashes of their surroundings with their lengths.
    """
    n, w = len(data), match - gram + 1
    none = np.zeros(0, np.int64)
    if n < match:
        return none, none.view(np.uint64), none.view(np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = _sliding(h, w, np.minimum, 2**64 - 1)  # of the strings in the 200 bytes from each place on
    starts = np.arange(len(least))
    least[starts + match > end[: len(least)]] = 0
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero((_sliding(padded, w, np.maximum, 0) == h) & (h > 0))
    lo, hi = np.maximum(begin[at], at - (match - gram)), np.minimum(end[at], at + match)
    around = mix64((sums[hi] - sums[lo]) * down[lo] + mix64((at - lo).astype(np.uint64) * np.uint64(1024) + (hi - at).astype(np.uint64)))
    return at, h[at], around


def _pieces(offs: np.ndarray, size: int, margin: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, from, to): stretches of the buffer to look at, and the part of each whose anchors count."""
    i, last = 0, len(offs) - 1
    while i < last:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        if j > i:
            yield int(offs[i]), int(offs[j]), int(offs[i]), int(offs[j])
            i = j
            continue
        for at in range(int(offs[i]), int(offs[i + 1]), size):
            to = min(at + size, int(offs[i + 1]))
            yield max(int(offs[i]), at - margin), min(int(offs[i + 1]), to + margin), at, to
        i += 1


def anchor_rows(docs: DataFrame, match: int, gram: int) -> DataFrame:
    """(doc_id, h, pos, n_before, n_after, kh, ch) of every anchor."""
    rows = docs.select("doc_id", text_key().alias("h"), F.col("text").cast("string").alias("text"))
    fields = "pos long, before short, after short, kh long, ch long"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, {fields}"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for lo, hi, first, to in _pieces(offs, PIECE, 2 * match):
                part = np.unique(np.clip(offs, lo, hi))
                sizes = np.diff(part)
                begin, end = np.repeat(part[:-1], sizes) - lo, np.repeat(part[1:], sizes) - lo
                at, kh, ch = anchors(data[lo:hi], begin, end, match, gram)
                keep = (at + lo >= first) & (at + lo < to)
                at, kh, ch = at[keep] + lo, kh[keep], ch[keep]
                doc = np.searchsorted(offs, at, "right") - 1
                pos = at - offs[doc]
                before, after = np.minimum(pos, match - gram), np.minimum(offs[doc + 1] - at, match)
                names = ["doc_id", "h", "pos", "before", "after", "kh", "ch"]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(pos), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16)), pa.array(kh.view(np.int64)), pa.array(ch.view(np.int64))], names=names)

    return rows.mapInArrow(find, schema)


# --- deep-shallow sorting --------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie that holds only branching depths and bytes; a search compares with one string at its end."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, [first]  # leaf: [ids of equal strings...]; inner: (depth, {byte: node})

    def _leaf(self, node) -> list[int]:
        while isinstance(node, tuple):
            node = next(iter(node[1].values()))
        return node

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, tuple):  # blind descent: follow known bytes, else any way
            depth, ways = node
            node = ways.get(s[depth] if depth < len(s) else -1) or next(iter(ways.values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(i)
            return
        depth = common(s, other)
        branch = lambda t: t[depth] if depth < len(t) else -1
        parent, way, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, way = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][way]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][branch(s)] = [i]
            return
        new = (depth, {branch(self.strings[self._leaf(node)[0]]): node, branch(s): [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][way] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows, padded with zero bytes to a multiple of eight, and their lengths."""
    size = np.array([len(x) for x in strings], np.int64)
    width = max(8, -(-int(size.max(initial=0)) // 8) * 8)
    rows = np.zeros((len(strings), width), np.uint8)
    rows[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return rows, size


def ranked(bucket: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their buckets, and the common prefix of each with the one before it (-1: another bucket).

    Multikey quicksort on 8-byte keys, all groups of a depth at once, down to ``shallow`` bytes; groups that are still equal
    there are ordered by blind tries. Padding is safe: a string sorts before its continuations, and lengths break ties.
    """
    rows, size = _matrix(strings)
    keys = rows.view(">u8")
    order = np.argsort(bucket, kind="stable")
    group = np.cumsum(np.diff(bucket[order], prepend=bucket[order[:1]]) != 0)
    for depth in range(min(shallow, rows.shape[1]) // 8):
        many = np.flatnonzero(np.bincount(group)[group] > 1)  # places of strings that are not alone in their group
        if not len(many):
            break
        key = keys[order[many], depth]
        moved = np.lexsort((key, group[many]))
        order[many] = order[many][moved]
        split = np.zeros(len(order), bool)
        split[many[1:]] = (key[moved][1:] != key[moved][:-1]) & (group[many][1:] == group[many][:-1])
        group = np.cumsum(split | (np.diff(group, prepend=group[:1]) != 0))
    times = np.bincount(group)
    first = np.cumsum(times) - times
    for at, n in zip(first[times > 1].tolist(), times[times > 1].tolist(), strict=True):
        ids = order[at : at + n].tolist()
        trie = BlindTrie(strings, ids[0])
        for i in ids[1:]:
            trie.insert(i)
        order[at : at + n] = trie.order()
    lcp = np.full(len(order), -1, np.int64)
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    lcp[1:] = np.where(bucket[a] == bucket[b], np.minimum(shared, np.minimum(size[a], size[b])), -1)
    return order, lcp


def reaches(bucket: np.ndarray, before: list[bytes], after: list[bytes], match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many bytes before and after it lie in ``match``-byte strings of another place of its bucket.

    ``before``: reversed bytes before each place; ``after``: bytes from it on. -1 where there is no such string.
    """
    n = len(after)
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    (o1, l1), (o2, l2) = ranked(bucket, before), ranked(bucket, after)
    size1, size2 = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    c1, c2 = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(max(l1.max(), 0)), max(0, match - int(l2.max())) - 1, -1):
        # classes of places that share d bytes before and match - d after
        c1[o1], c2[o2] = np.cumsum(l1 < d), np.cumsum(l2 < match - d)
        able = np.flatnonzero((size1 >= d) & (size2 >= match - d))
        if len(able) < 2:
            continue
        key = c1[able] * (n + 1) + c2[able]
        turn = np.argsort(key, kind="stable")
        same = key[turn][1:] == key[turn][:-1]
        twin = np.zeros(len(able), bool)
        twin[turn[1:][same]] = twin[turn[:-1][same]] = True
        good = able[twin]
        left[good] = np.maximum(left[good], d)
        right[good] = np.maximum(right[good], match - d)
    return left, right


# --- the operator ----------------------------------------------------------------------------------------------------


def _surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (doc_id, h, pos, before, after, kh, ch, n) with ``body``, the bytes around each place."""
    asked = places.groupBy(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h")).agg(F.collect_list(F.struct("pos", "before", "after", "kh", "ch", "n")).alias("asked"))
    both = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))).select("text", F.explode("asked").alias("p"))
    cut = F.call_function("substring", F.col("text").cast("binary"), (F.col("p.pos") - F.col("p.before") + 1).cast("int"), (F.col("p.before") + F.col("p.after")).cast("int"))
    return both.select("p.kh", "p.ch", "p.n", F.col("p.before").cast("int").alias("before"), cut.alias("body"))


def _sorted_buckets(rows: DataFrame, match: int) -> DataFrame:
    """(kh, ch, left, right) of the surroundings in buckets that fit a task; a sort takes ``SORTED`` strings of whole buckets."""

    def solved(held: list[tuple]) -> pa.RecordBatch:
        kh, ch, before, body = (list(x) for x in zip(*held, strict=True)) if held else ([], [], [], [])
        if not held:
            left = right = np.zeros(0, np.int64)
        else:
            left, right = reaches(np.array(kh), [b[:x][::-1] for x, b in zip(before, body, strict=True)], [b[x:] for x, b in zip(before, body, strict=True)], match)
        hit = np.flatnonzero(left >= 0)
        columns = [pa.array(np.array(kh, np.int64)[hit]), pa.array(np.array(ch, np.int64)[hit]), pa.array(left[hit].astype(np.int32)), pa.array(right[hit].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["kh", "ch", "left", "right"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("kh", "ch", "before", "body")), strict=True):
                if len(held) >= SORTED and row[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                held.append(row)
        yield solved(held)

    return rows.select("kh", "ch", "before", "body").repartition("kh").sortWithinPartitions("kh").mapInArrow(resolve, "kh long, ch long, left int, right int")


def _counted_buckets(rows: DataFrame, match: int) -> DataFrame:
    """The same for larger buckets: every ``match``-byte string around a place is a row, and rows are counted."""
    at = rows.filter(F.octet_length("body") >= match).select("kh", "ch", "before", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - match)).alias("s")).filter(F.col("s") <= F.col("before"))
    at = at.select("kh", "ch", (F.col("before") - F.col("s")).alias("d"), F.call_function("substring", "body", F.col("s") + 1, F.lit(match)).alias("string"))
    at = at.withColumns({"s1": F.xxhash64("string"), "s2": F.xxhash64("string", F.lit(1))})
    key = ["kh", "d", "s1", "s2"]
    twice = at.groupBy(*key).agg(F.count("*").alias("c"), F.min("string").alias("lo"), F.max("string").alias("hi")).filter("c > 1")
    twice = written(twice.select(*key, (F.col("lo") == F.col("hi")).alias("equal")), "suffix-counted")
    both = at.join(twice, key)
    # hashes of different strings: these are counted by their bytes
    torn = both.filter("NOT equal")
    found = both.filter("equal").select("kh", "ch", "d").unionAll(torn.join(torn.groupBy(*key, "string").count().filter("count > 1").drop("count"), [*key, "string"]).select("kh", "ch", "d"))
    return found.groupBy("kh", "ch").agg(F.max("d").cast("int").alias("left"), (match - F.min("d")).cast("int").alias("right"))


def suffix_dedup(docs: DataFrame, match: int = MATCH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the removed runs and the remaining bytes."""
    places = written(anchor_rows(docs, match, gram), "suffix-anchors")
    twice = places.groupBy("kh").agg(F.count("*").alias("n"), F.min("ch").alias("c0"), F.max("ch").alias("c1")).filter("n > 1")
    # a table of its own, so that the join is one of two scans, whose hot keys Spark can split
    twice = written(twice.select("kh", (F.col("c0") != F.col("c1")).alias("mixed")), "suffix-twice")
    shared = written(places.join(twice, "kh"), "suffix-shared")
    forget(places, twice)
    mixed = shared.filter("mixed")
    distinct = mixed.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "pos", "before", "after")).alias("p")).select("kh", "ch", "n", "p.*")
    distinct = written(distinct, "suffix-distinct")
    per = distinct.groupBy("kh").agg(F.count("*").alias("m"))
    large = written(per.filter(F.col("m") > bucket).select("kh"), "suffix-large")

    texts = docs.select("doc_id", text_key().alias("h"), F.col("text").cast("string").alias("text"))
    around = _surroundings(texts, distinct)
    hot = large.limit(1).count() > 0
    found = _sorted_buckets(around.join(large, "kh", "left_anti") if hot else around, match)
    if hot:
        found = found.unionAll(_counted_buckets(around.join(large, "kh", "left_semi"), match))
    # whole surroundings are shared where they occur twice; else what the bucket gave
    found = distinct.filter("n > 1").select("kh", "ch", F.col("before").cast("int").alias("left"), F.col("after").cast("int").alias("right")).unionAll(found)
    found = written(found.groupBy("kh", "ch").agg(F.max("left").alias("left"), F.max("right").alias("right")), "suffix-found")
    forget(distinct, large)
    spans = shared.filter("NOT mixed").select("doc_id", "h", "pos", F.col("before").cast("int").alias("left"), F.col("after").cast("int").alias("right"))
    spans = spans.unionAll(mixed.join(found, ["kh", "ch"]).select("doc_id", "h", "pos", "left", "right"))
    spans = spans.filter(F.col("left") + F.col("right") >= match)
    cuts = spans.groupBy(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h")).agg(F.collect_set(F.struct((F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b"))).alias("cuts"))
    both = texts.join(cuts, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
    return _cut(both.select("doc_id", "text", "cuts.a", "cuts.b"))


def _cut(rows: DataFrame) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True):
                raw, runs = (text or "").encode(), []
                for x, y in sorted(zip(a or [], b or [], strict=True)):
                    if runs and x <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], y)
                    else:
                        runs.append({"start": x, "end": y})
                at = [0, *(e for r in runs for e in (r["start"], r["end"])), len(raw)]
                sizes.append(len(raw))
                spans.append(runs)
                kept.append(b"".join(raw[at[i] : at[i + 1]] for i in range(0, len(at), 2)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
