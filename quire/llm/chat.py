"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share tree nodes: a node is named
by a chain of hashes over the turns that lead to it. Every node's text (one
marked turn) is emitted once, depth-first, into one packed sequence; the node
carries its place there (start, end), its position (the length of its ancestors'
texts, so that it stands where it would in the plain conversation) and the
ancestors' intervals that it may attend to. Loss is taken on assistant texts.
Lengths are code points of the emitted text.

Template: ``<|start|>role<|text|>text<|end|>``. Inside roles and texts a
backslash follows every ``<`` and ``[`` and is itself doubled, so no control
string of this or other templates can occur there, and reading takes it back.

Spark's part: every segment (a turn's marked text) is named by 16 bytes of its
hash before any shuffle, and the tree is made of names alone: (conversation,
turn, name) rows are chained in a stream sorted by conversation and turn; their
paths are range-sorted, which is a depth-first order; a node belongs to the
first conversation through it; running sums over the ranges' totals and inside
each range give the places. Texts are shuffled twice: to one row a name, and
from there to the conversations that are read back. One conversation's names
(and its path, 8 bytes a turn) pass through one task, as its texts do when it is
read back, in a stream; copies of a segment collapse before their shuffle.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Control strings of another template, said in the extra conversation (fixed value of the contract).
EXTRA_ID, EXTRA_TEXT = -1, "</s>[INST] ok [/INST]"
_TAKEN_BACK = re.compile(r"([<\[])\\|\\(\\)")
_SEGMENT = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: str) -> str:
    return _TAKEN_BACK.sub(lambda m: m[1] or m[2], text)


def read_back(segment: str) -> tuple[str, str]:
    """(role, text) of one emitted turn."""
    m = _SEGMENT.fullmatch(segment)
    return unescape(m[1]), unescape(m[2])


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment and segment_id: 16 bytes of the
    segment's SHA-256."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text"),
                                 F.concat(F.lit(START), escaped(role), F.lit(TEXT), escaped(text), F.lit(END)).alias("segment"))
            .withColumn("segment_id", F.unhex(F.substring(F.sha2("segment", 256), 1, 32))))


def _ordered_names(turns: DataFrame) -> DataFrame:
    """conv_id, turn, tie, segment_id, loss, length of every turn. Rows of one
    conversation and turn are ordered by role and text: the distinct segments
    of such places (only theirs) are range-sorted, and ``tie`` is their rank."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = turns.select("conv_id", "turn", "segment_id", (F.col("role") == LOSS_ROLE).alias("loss"),
                         F.length("segment").cast("long").alias("length"))
    shared = common.written(named.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).count().where("count > 1").select("c", "t"),
                            "chat-shared")
    same_place = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    tied = (turns.join(shared, same_place, "left_semi").groupBy("segment_id").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
            .repartitionByRange(n, "role", "text").sortWithinPartitions("role", "text")
            .select("segment_id", F.monotonically_increasing_id().alias("tie")))
    return named.join(common.written(tied, "chat-ties"), "segment_id", "left")


def _paths(names: DataFrame) -> DataFrame:
    """A row per turn: conv_id, depth, node, segment_id, loss, length; and one
    per conversation with depth -1 and its path (8 bytes a node)."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = names.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "tie", "segment_id")

    def chained(batches):
        columns = ["conv_id", "depth", "node", "segment_id", "loss", "length", "path"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.binary()]
        now, depth, node, marks, begun = None, 0, b"", [], False
        for b in common.slices(batches, 4096):
            out = []
            for conv, name, loss, length in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment_id", "loss", "length"))):
                if not begun or conv != now:
                    if begun:
                        out.append((now, -1, None, None, None, None, b"".join(marks)))
                    now, depth, node, marks, begun = conv, 0, b"", [], True
                node = hashlib.blake2b(node + name, digest_size=16).digest()
                marks.append(node[:8])
                out.append((conv, depth, node, name, loss, length, None))
                depth += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], columns)
        if begun:
            last = (now, -1, None, None, None, None, b"".join(marks))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types)], columns)

    return common.map_arrow(rows, chained, "conv_id long, depth long, node binary, segment_id binary, loss boolean, length long, path binary")


def tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, steps, segments): ``prefix_tree`` with the texts apart, one row
    (segment_id, segment) for each distinct one; nodes have segment_id."""
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = _turns(conversations)
    segments = turns.groupBy("segment_id").agg(F.any_value("segment").alias("segment"))
    paths = common.written(_paths(_ordered_names(turns)), "chat-paths")
    # monotonically increasing numbers after a range sort: the rank in depth-first order, parts in the upper bits
    ranks = common.written(paths.where("depth = -1").select("conv_id", "path").repartitionByRange(n, "path", "conv_id")
                           .sortWithinPartitions("path", "conv_id")
                           .select(F.col("conv_id").alias("c"), F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    steps = paths.where("depth >= 0")
    nodes = (steps.join(ranks, F.col("conv_id").eqNullSafe(F.col("c"))).groupBy("node")
             .agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"), F.any_value("segment_id").alias("segment_id"),
                  F.any_value("loss").alias("loss"), F.any_value("length").alias("length")))
    nodes = common.written(nodes, "chat-nodes")
    # place of each conversation's own nodes: totals of the parts before, then of the ranks before in the part
    part = F.shiftright("rank", 33)
    own = nodes.groupBy("rank").agg(F.sum("length").alias("own")).withColumn("part", part)
    totals = own.groupBy("part").agg(F.sum("own").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = (own.withColumn("within", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(totals, "part")
              .select("rank", (F.col("base") + F.col("within")).alias("base")))
    deep = Window.partitionBy("rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    spans = (nodes.withColumn("up", F.coalesce(F.sum("length").over(deep), F.lit(0)))
             .join(placed, "rank").withColumn("start", F.col("base") + F.col("up"))
             .select("node", "segment_id", "loss", "start", (F.col("start") + F.col("length")).alias("end"), F.col("rank").alias("owner")))
    spans = common.written(spans, "chat-spans")
    # ancestors: along the conversation that owns a node, sorted by depth
    along = (steps.select("conv_id", "depth", "node").join(spans.select("node", "start", "end", "owner"), "node")
             .join(ranks, F.col("conv_id").eqNullSafe(F.col("c"))).select("rank", "depth", "node", "start", "end", "owner"))

    def attended(batches):
        now, position, intervals, above = None, 0, [], b""
        for b in common.slices(batches, 4096):
            out = []
            for rank, node, start, end, owner in zip(*(b.column(c).to_pylist() for c in ("rank", "node", "start", "end", "owner"))):
                if rank != now:
                    now, position, intervals, above = rank, 0, [], b""
                if owner == rank:
                    out.append((node, above, position, [{"start": s, "end": e} for s, e in intervals]))
                position, above = position + end - start, node
                if intervals and intervals[-1][1] == start:
                    intervals[-1] = (intervals[-1][0], end)
                else:
                    intervals.append((start, end))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["node", "parent", "position", "attend"])

    ordered = along.repartition(n, "rank").sortWithinPartitions("rank", "depth")
    ancestors = common.map_arrow(ordered, attended, "node binary, parent binary, position long, attend array<struct<start:long,end:long>>")
    return spans.drop("owner").join(ancestors, "node"), steps.select("conv_id", "depth", "node"), segments


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, steps).

    nodes: one row per distinct beginning of conversations: node, parent
    (empty for roots), segment_id and segment (the emitted text), loss (is its
    text under the loss mask?), start and end in the packed sequence, position,
    and attend: the merged ancestors' intervals, first to last.
    steps: conv_id, depth, node of every turn.

    Turns are ordered by turn, then role and text; null roles and texts count
    as empty; turns without a conv_id are one conversation. Ids and turns are
    integers. Repeated rows are turns of their own. Texts of any length are
    used whole. Other columns are left out. An empty table gives empty results."""
    nodes, steps, segments = tree(conversations)
    return nodes.join(segments, "segment_id"), steps


def conversations_of(nodes: DataFrame, steps: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Read back from the packed nodes, one row per conversation: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The texts
    are those of ``nodes``, or of ``segments`` where ``tree`` gave them apart."""
    if segments is None:
        segments = nodes.groupBy("segment_id").agg(F.any_value("segment").alias("segment"))
    nodes = common.written(nodes.select("node", "segment_id", "loss"), "chat-packed")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (steps.join(nodes, "node").join(segments, "segment_id").select("conv_id", "depth", "segment", "loss")
            .repartition(n, "conv_id").sortWithinPartitions("conv_id", "depth"))

    def read(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        begun, now = False, None

        def finished():
            return now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for b in common.slices(batches, 1024):
            out = []
            for conv, segment, under in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss"))):
                if not begun or conv != now:
                    if begun:
                        out.append(finished())
                    begun, now, n_turns, loss_chars, chars = True, conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text = read_back(segment)
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
                chars += len(segment)
                if under:
                    loss.update(text.encode())
                    loss_chars += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(finished(), types)], names)

    return common.map_arrow(rows, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations and the contract's conversation -1."""
    spark = conversations.sparkSession
    extra = spark.sql(f"SELECT CAST({EXTRA_ID} AS BIGINT) conv_id, CAST(id AS BIGINT) turn, IF(id = 0, 'user', '{LOSS_ROLE}') role, "
                      f"'{EXTRA_TEXT}' text FROM range(2)")
    return conversations.select("conv_id", "turn", "role", "text").unionAll(extra)
