"""MinHash near-duplicates: universal hash minima, banding, signature verification, alternating stars.

1. Each text becomes its set of k-word shingles (64-bit hashes) and a signature of 128 minima under multiply-shift
   hashes. Texts with the same set form one class, the node of everything that follows, so exact copies are never paired.
2. Signatures are cut into 32 bands of 4; equal bands are a bucket. The head of a bucket is its class with the most
   bucket neighbours in all its bands, so the centre of a group of near copies heads most of their buckets.
3. Every class is compared with the heads of its buckets: signatures first (equal low bytes), then the full shingle sets.
   The links' components come from alternating large-star and small-star.
4. Where the classes around a head still belong to several components, every class outside the largest of them is
   compared with all classes around that head, in the same two steps. Two classes of one bucket are both around its head, so
   every pair that shares a bucket is either in one component by then or compared.

Comparisons run inside tasks on blocks of bounded size: a block of classes is loaded, another streams past it, and only
links between components that the block has not joined yet leave the task, so no list of pairs exists at any size of a
group. A group of near copies costs one comparison a copy in step 3; step 4 costs the copies outside the main component
times the group, which is the work left where texts truly lie around the threshold.

Two texts at the threshold of 0.8 share no bucket with probability (1 - 0.8**4)**32, about 5e-8, and are dropped at AGREE
with about 8e-8; both fall quickly above it, and matter only where no other link joins the two.

Defined results: null and wordless texts have the empty set and link with nothing; a text of fewer than k words has its
word sequence as its only shingle; rows without an id get a null component and are not kept; rows that repeat an id and a
text are one document; an id that stands with two different texts names two documents, each in the group of its own text;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import bounded, forget, mix64, shingle_set, table, text_buffer, text_key, written
from alphaloom.llm.components import components

BANDS, ROWS, SHINGLE, THRESHOLD, SEED = 32, 4, 2, 0.8, 20240229
#: Share of equal minima below which a pair is dropped: five and a half standard deviations under the threshold.
AGREE = 0.60
#: Shingles in a block of compared classes (a single class may have more).
BLOCK = 1 << 20


def _hash_family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and increments of n multiply-shift hashes."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The 32-bit minima of the set under each hash; long sets go through in blocks."""
    a, b = family
    best = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        best = np.minimum(best, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key of each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mix64(key + column)
    return key.view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, n, lo, hi, keys, low) of every row: text key, set size, 128 bits that name the set, the bucket keys and
    the low bytes of the signature."""
    long = T.LongType()
    named = (("h", long), ("n", long), ("lo", long), ("hi", long), ("keys", T.ArrayType(long)), ("low", T.BinaryType()))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in named)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _hash_family(BANDS * ROWS)
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            n, lo, hi, keys, low = [], [], [], [], []
            for i in range(len(offs) - 1):
                s = shingle_set(data[offs[i] : offs[i + 1]], k)
                n.append(len(s))
                lo.append(int(s.sum().view(np.int64)) if len(s) else 0)
                hi.append(int(mix64(s ^ np.uint64(SEED)).sum().view(np.int64)) if len(s) else 0)
                sig = signature(s, family) if len(s) else None
                keys.append(band_keys(sig) if len(s) else None)
                low.append(sig.astype(np.uint8).tobytes() if len(s) else None)
            columns = [pa.array(x, pa.int64()) for x in (n, lo, hi)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns, pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=schema.names)

    return docs.select("doc_id", text_key().alias("h"), F.col("text").cast("string").alias("text")).mapInArrow(sign, schema)


class Block:
    """Loaded classes: their signatures, and an index from shingles to the classes that hold them."""

    def __init__(self, comps: list[int], lows: list[bytes], sets: list[np.ndarray], per_cent: int):
        self.per_cent, self.sets = per_cent, sets
        self.comps = np.array(comps, np.int64)
        self.lows = np.frombuffer(b"".join(lows), np.uint8).reshape(len(lows), -1)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.parent: dict[int, int] = {}
        self.words = None

    def root(self, comp: int) -> int:
        while comp in self.parent:
            comp = self.parent[comp]
        return comp

    def _index(self) -> None:
        tokens, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.n)
        order = np.argsort(tokens, kind="stable")
        self.words, self.first, self.times = np.unique(tokens[order], return_index=True, return_counts=True)
        self.owner = owner[order]

    def shared(self, s: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``s`` with the ``wanted`` loaded classes."""
        if len(wanted) <= 4:
            return np.array([len(np.intersect1d(s, self.sets[i], assume_unique=True)) for i in wanted], np.int64)
        if self.words is None:
            self._index()
        at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
        at = at[self.words[at] == s]
        times = self.times[at]
        spots = np.repeat(self.first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.bincount(self.owner[spots], minlength=len(self.sets))[wanted]

    def links(self, comp: int, n: int, low: bytes, text: str, k: int) -> Iterator[tuple[int, int]]:
        """Links of a class to loaded ones of components that this block has not joined with its own yet."""
        able = (np.minimum(self.n, n) * 100 >= np.maximum(self.n, n) * self.per_cent) & (self.comps != self.root(comp))
        wanted = np.flatnonzero(able)
        if len(wanted):
            wanted = wanted[(self.lows[wanted] == np.frombuffer(low, np.uint8)).mean(axis=1) >= AGREE]
        if not len(wanted):
            return
        c = self.shared(shingle_set(np.frombuffer(text.encode(), np.uint8), k), wanted)
        for i in wanted[(c > 0) & (100 * c >= self.per_cent * (self.n[wanted] + n - c))]:
            x, y = int(self.comps[i]), self.root(comp)
            if x != y:
                yield x, y
                self.parent[y] = x
                self.comps[self.comps == y] = x


def _links(loaded: DataFrame, streamed: DataFrame, bodies: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links (a, b) of components between the loaded and the streamed classes of each block (g, i, j).

    Both have (g, i, j, node, comp). ``bodies`` has (node, n, low, text).
    """
    rows = loaded.withColumn("streams", F.lit(False)).unionByName(streamed.withColumn("streams", F.lit(True))).join(bodies, "node")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "streams", "node")
    per_cent = round(100 * threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block, held = None, None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            lists = (batch.column(c).to_pylist() for c in ("g", "i", "j", "streams", "comp", "n", "low"))
            for r, (g, i, j, streams, comp, n, low) in enumerate(zip(*lists, strict=True)):
                if (g, i, j) != unit:
                    unit, block, held = (g, i, j), None, []
                text = batch.column("text")[r].as_py()
                if not streams:
                    held.append((comp, low, shingle_set(np.frombuffer(text.encode(), np.uint8), k)))
                    continue
                if block is None:
                    block = Block(*(list(x) for x in zip(*held, strict=True)), per_cent)
                found += block.links(comp, n, low, text, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return rows.select("g", "i", "j", "streams", "comp", "n", "low", "text").mapInArrow(compare, "a long, b long")


def _tiles(size) -> F.Column:
    return F.ceil(size / F.lit(BLOCK)).cast("int")


def _groups(classes: DataFrame) -> DataFrame:
    """(head, node, n): the classes around each head, heads included."""
    spread = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = written(spread.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "neardup-buckets")
    members = written(spread.join(bounded(shared), "key"), "neardup-members")
    crowd = written(members.groupBy("node").agg(F.sum("c").alias("crowd")), "neardup-crowds")
    heads = written(members.join(crowd, "node").groupBy("key").agg(F.max(F.struct("crowd", "node")).alias("m")).select("key", F.col("m.node").alias("head")), "neardup-heads")
    groups = written(members.join(heads, "key").select("head", "node", "n").distinct(), "neardup-groups")
    forget(shared, members, crowd, heads)
    return groups


def _bodies(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, n, low, text) of every class that shares a bucket."""
    wanted = written(classes.join(groups.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.h").alias("r_h")), "neardup-wanted")
    texts = docs.select("doc_id", text_key().alias("h"), F.col("text").cast("string").alias("text"))
    texts = texts.join(bounded(wanted), (F.col("doc_id") == F.col("r_id")) & (F.col("h") == F.col("r_h"))).groupBy("node").agg(F.first("text").alias("text"))
    bodies = written(texts.join(classes.select("node", "n", "low"), "node"), "neardup-bodies")
    forget(wanted)
    return bodies


def _around_heads(groups: DataFrame, bodies: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links of classes with the heads of their buckets."""
    tiles = written(groups.groupBy("head").agg(_tiles(F.sum("n")).alias("tiles")), "neardup-tiles")
    place = lambda node, comp, j: [F.col("head").alias("g"), F.lit(0).alias("i"), j.alias("j"), F.col(node).alias("node"), F.col(comp).alias("comp")]
    loaded = tiles.select("head", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j")).select(*place("head", "head", F.col("j")))
    streamed = groups.filter("node <> head").join(tiles, "head").select(*place("node", "node", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    links = written(_links(loaded, streamed, bodies, k, threshold), "neardup-links")
    forget(tiles)
    return links


def _across(groups: DataFrame, comps: DataFrame, bodies: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links between the components that stand around one head."""
    placed = written(groups.join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "neardup-placed")
    per = placed.groupBy("head", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    main = per.groupBy("head").agg(F.max(F.struct("k", "comp", "w")).alias("m"), F.count("*").alias("kinds"), F.sum("w").alias("all")).filter("kinds > 1")
    main = written(main.select("head", F.col("m.comp").alias("main"), _tiles(F.col("all") - F.col("m.w")).alias("ti"), _tiles(F.col("all")).alias("tj")), "neardup-main")
    open_ = written(placed.join(main, "head"), "neardup-open")
    forget(placed, main)
    tile = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    loaded = open_.filter("comp <> main").select(F.col("head").alias("g"), tile("ti").alias("i"), every("tj").alias("j"), "node", "comp")
    streamed = open_.select(F.col("head").alias("g"), every("ti").alias("i"), tile("tj").alias("j"), "node", "comp")
    links = written(_links(loaded, streamed, bodies, k, threshold), "neardup-across")
    forget(open_)
    return links


def near_dedup(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, h) of every row; ``h`` is the key of its text."""
    signs = written(signed(docs, k), "neardup-signed")
    name = ["n", "lo", "hi"]
    known = signs.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = known.groupBy(*name).agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("keys").alias("keys"), F.first("low").alias("low"))
    # the numbers are fixed by the write: every later step reads the written ones
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
    rows = written(signs.select("doc_id", "h", *name), "neardup-rows")
    forget(signs)

    groups = _groups(classes)
    bodies = _bodies(docs, classes, groups)
    links = _around_heads(groups, bodies, k, threshold)
    comps = written(components(links), "neardup-components")
    more = _across(groups, comps, bodies, k, threshold)
    forget(links, bodies, groups)
    joined = written(components(more), "neardup-joined").select(F.col("node").alias("label"), F.col("component").alias("joined"))
    forget(more)

    named = classes.select("node", *name, F.col("rep.doc_id").alias("least")).join(comps, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    named = written(named.join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label")).select("label", "least", *name), "neardup-named")
    least = written(named.groupBy("label").agg(F.min("least").alias("found")), "neardup-least")
    named = written(named.join(least, "label").select("found", *(F.col(c).alias(f"c_{c}") for c in name)), "neardup-found")
    same = [F.col(c) == F.col(f"c_{c}") for c in name]
    out = rows.join(named, same[0] & same[1] & same[2] & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "h")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("h")


#: Exact links over all pairs that share a shingle; feasible for a small corpus only.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.o = u.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
