"""Chat formatting: reply trees to conversations with a loss mask.

Messages name their parent. ``reply_paths`` finds the branches of each tree by iterative self-joins: links are joined with themselves, so
round i knows who stands 2**i messages above, and a path of d messages takes log2(d) rounds whatever the shape of the tree. Leaves climb
the rounds from the longest jump down and bring along the depth and the summed score of their branch; branches are ranked by their mean
score, and only the chosen ones are expanded again, each message in as many rows as chosen branches pass through it. All of this moves
ids and scores; texts are joined to the expanded paths once and meet once more as the conversation they make up. A conversation is one
sample, so it must fit in a row; nothing larger is ever together.

Template: ``<s>`` opens a conversation; a user turn is ``[INST] text [/INST]``, another role ``[INST] <<role>> text [/INST]``, an assistant
turn ``text</s>``. Inside texts a backslash is doubled, and one is put behind the first character of ``<s>``, ``</s>``, ``[INST]``,
``[/INST]`` and ``<<``, so no text holds a control string and dropping single backslashes restores it. The loss mask covers the texts
of assistant turns: places in code points of the formatted string.

Defined results: null texts and roles count as empty; a parent that is null, absent or the message itself makes a root; messages on a cycle of
parents or below one are on no branch; rows that repeat a message's id stand together at its place, in the order of role and text, with
the smallest parent and the best score among them; branches of equal score rank by the leaf's id; a null tree id names one tree; an empty
table gives no rows. Conversations by turn: null turns come first, rows of one turn follow in the order of role, then of a hash of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import forget, table, written

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
CONTROL = re.compile(r"\\|<(?=/?s>|<)|\[(?=/?INST\])")
#: Turns of a conversation that one window orders.
SPAN = 4096


# --- the template ----------------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it that carry loss."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            spans.append((at, at + len(body)))
            part = body + END
        elif role == "user":
            part = OPEN + body + CLOSE
        else:
            part = f"{OPEN}<<{escape(role).replace('>', '>' + chr(92))}>> {body}{CLOSE}"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            end = formatted.index(END, at)
            turns.append(("assistant", unescape(formatted[at:end])))
            at = end + len(END)
            continue
        at, role = at + len(OPEN), "user"
        if formatted.startswith("<<", at):
            end = formatted.index(">>", at)
            role, at = unescape(formatted[at + 2 : end]), end + 3
        end = formatted.index(CLOSE, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(CLOSE)
    return turns


def under_mask(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text that carries loss, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


# --- trees -----------------------------------------------------------------------------------------------------------


def _jumps(links: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, gained) of the ancestors 1, 2, 4, ... above, and the scores from the node up to below there.

    The last one may hold messages on or below cycles only: their jumps never end.
    """
    other = links.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    first = links.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("node")))
    first = first.join(other, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")))
    levels = [written(first.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gained")), "chat-jump-0")]
    rows = links.count()
    while 2 ** (len(levels) - 1) <= rows and levels[-1].limit(1).count():
        b = levels[-1].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("gained").alias("g2"))
        twice = levels[-1].join(b, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        levels.append(written(twice.select("tree", "node", F.col("up2").alias("up"), (F.col("gained") + F.col("g2")).alias("gained")), f"chat-jump-{len(levels)}"))
    return levels


def _leaves(links: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, depth, score) of every branch: the leaf's depth below its root and the mean score of the messages on the branch."""
    busy = levels[0].select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
    out = links.join(busy, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    endless = levels[-1].select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    out = out.join(endless, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    out = out.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("total"))
    for i in range(len(levels) - 2, -1, -1):
        b = levels[i].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up", "gained")
        out = out.join(b, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("at") == F.col("n2")), "left").select(
            "tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNotNull(), 2**i).otherwise(0)).alias("depth"), (F.col("total") + F.coalesce("gained", F.lit(0.0))).alias("total"),
        )
    roots = links.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("score").alias("s2"))
    out = out.join(roots, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("at") == F.col("n2")))
    return out.select("tree", "leaf", "depth", ((F.col("total") + F.col("s2")) / (F.col("depth") + 1)).alias("score"))


def reply_paths(links: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, leaf, position, node) of every message on the ``top`` best branches of each tree.

    ``links``: (tree, node, parent, score). Ranks start at 1, positions at 0, the root's.
    """
    links = written(links.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.coalesce(F.max("score"), F.lit(0.0)).cast("double").alias("score")), "chat-links")
    levels = _jumps(links)
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    rows = _leaves(links, levels).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)  # limited per task before the shuffle
    rows = rows.select("tree", "rank", "leaf", "depth", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for i in range(len(levels) - 2, -1, -1):
        b = levels[i].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        here = F.struct("node", "back")
        above = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("back") + 2**i).alias("back")))
        rows = rows.join(b, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left").select("tree", "rank", "leaf", "depth", F.explode(F.array_compact(F.array(here, above))).alias("x"))
        rows = rows.select("tree", "rank", "leaf", "depth", "x.node", "x.back")
    out = written(rows.select("tree", "rank", "leaf", (F.col("depth") - F.col("back")).alias("position"), "node"), "chat-paths")
    forget(links, *levels)
    return out


# --- conversations ---------------------------------------------------------------------------------------------------


def samples(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, rank, leaf, n_turns, formatted, loss) of every path; ``texts``: (tree, node, role, text)."""
    p = paths.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "rank", "leaf", "position")
    text = texts.select("tree", "node", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = text.join(p, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "rank", "leaf", "position", "role", "text")
    rows = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "rank", "leaf", "position", "role", "text")
    ids = [(c, rows.schema[c].dataType.simpleString()) for c in ("tree", "rank", "leaf")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, types = None, [], None

        def done() -> pa.RecordBatch:
            text, spans = format_turns(turns)
            columns = [pa.array([v], t) for v, t in zip(key, types, strict=True)]
            columns += [pa.array([len(turns)], pa.int64()), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], span)]
            return pa.RecordBatch.from_arrays(columns, names=["tree", "rank", "leaf", "n_turns", "formatted", "loss"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("tree", "rank", "leaf")]
            for *own, role, text in zip(*(batch.column(c).to_pylist() for c in ("tree", "rank", "leaf", "role", "text")), strict=True):
                if own != key:
                    if turns:
                        yield done()
                    key, turns = own, []
                turns.append((role, text))
        if turns:
            yield done()

    return rows.mapInArrow(join, ", ".join(f"{c} {t}" for c, t in ids) + ", n_turns long, formatted string, loss array<struct<start: long, end: long>>")


def chat_samples(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best branches of each reply tree as formatted conversations; ``messages``: (tree, node, parent, role, text, score)."""
    return samples(messages, reply_paths(messages.select("tree", "node", "parent", "score"), top))


def threads(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations by turn as trees of one branch: the links, and the texts of their messages.

    A message's parent is the one before it; a window orders SPAN turns at most, the first of them follows the last of the span before.
    """
    rows = conversations.select(F.col("conv_id").alias("tree"), F.xxhash64("turn", "role", "text").alias("node"), "turn", "role", "text")
    light = rows.groupBy("tree", "node").agg(F.min("turn").alias("turn"), F.min("role").alias("role")).withColumn("span", F.call_function("div", F.col("turn"), F.lit(SPAN)))
    order = F.struct("turn", "role", "node")
    ends = light.groupBy("tree", "span").agg(F.max_by("node", order).alias("end"))
    ends = ends.select(F.col("tree").alias("t2"), F.col("span").alias("s2"), F.lag("end").over(Window.partitionBy("tree").orderBy("span")).alias("before"))
    linked = light.withColumn("up", F.lag("node").over(Window.partitionBy("tree", "span").orderBy(order)))
    linked = linked.join(ends, F.col("tree").eqNullSafe(F.col("t2")) & F.col("span").eqNullSafe(F.col("s2")))
    return linked.select("tree", "node", F.coalesce("up", "before").alias("parent"), F.lit(0.0).alias("score")), rows


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    links, texts = threads(conversations.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], conversations.schema)))
    out = samples(texts, reply_paths(links))
    kind = out.schema["tree"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns, masked = read_back(text), under_mask(text, [(x["start"], x["end"]) for x in loss])
                rows.append((len(turns), sha("".join(f"{role}\n{body}\n" for role, body in turns)), len(masked), sha(masked), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return out.select("tree", "formatted", "loss").mapInArrow(digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
times AS (SELECT *, length(text) + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '<', ''))) - len(regexp_extract_all(text, '<+'))
 + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\\[/?INST\\]')) AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + sum(body + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars FROM times GROUP BY conv_id"""
