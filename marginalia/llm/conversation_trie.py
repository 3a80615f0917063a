"""The prefix trie of conversations, by Patricia construction: sorted sequences, compressed edges, unary nodes expanded at the end.

A turn is a unit of 24 bytes: 16 that stand for its role and text, 8 for the number of its words. A conversation is the string of its
units, its key. Texts go no further than the scan. Conversations with one key are one row with a count.

Construction. The keys are sorted by range partitions. Each partition reads its keys in order; the common prefix of neighbours is a
branch, a key is an end (a leaf if nothing extends it), and only these get a node, with the edge that leads to it. Open nodes are a
stack as deep as the compressed path, and a node is written when the keys leave it, so memory doesn't grow with the partition. A node's
aggregates are sums of its children's: members, leaves, words weighted with members (a) and words (b), where saved = a - b.

Edges of partitions. Every partition is told the key before and the key behind it. The nodes on the prefixes it shares with them are the
only ones that several partitions see. Each of them is written as a node of its own by all of these, and the first one alone counts
its words and its place among its parent's children. So the parts add up: one grouping of these few rows.

Expansion. A unary node has the members and leaves of the node its edge leads to, and what is saved below it is that node's figure and
the edge's suffix sum of words, times the other members.

``ends_sha256`` is a hash of all members that end in a node, in order. They are sorted by node and id and hashed as a stream, so a sequence
that very many conversations have costs time in one task, but no memory.

Defined cases: rows without a conv_id belong to no conversation. Turns are ordered by turn, null first; equal ones by the MD5 of role
and text, and rows that repeat are turns of their own. A null role or text is empty. A conversation's units, 24 bytes a turn, are one row; its
texts aren't. A conversation that loses all turns is a member of the root. Only the four columns are read, whatever others are called. An
empty table gives an empty table, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, discard, materialize, record_batch

UNIT, PERIOD, HEADS = 24, 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """(conv_id, key) of every rebuilt conversation: its first turns, fewer than ``heads``, are those of the one its id is rounded down to."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), 16, "0")
    code = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), words)
    units = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"))
    own = units.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code")))["code"].alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % period
    first = own.filter(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    met = own.select("conv_id", "own", base.alias("base"), h.cast("int").alias("h")).join(first, "base", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), rest)
    return met.select("conv_id", F.unhex(F.array_join(whole, "")).alias("key"))


def common_units(a: bytes, b: bytes) -> int:
    n, most = 0, min(len(a), len(b)) // UNIT
    if most > 64 and a[: most * UNIT] == b[: most * UNIT]:
        return most
    while n < most and a[n * UNIT : (n + 1) * UNIT] == b[n * UNIT : (n + 1) * UNIT]:
        n += 1
    return n


def unit_words(key: bytes, start: int, end: int) -> np.ndarray:
    """The numbers of words of the units at the depths start + 1 to end."""
    return np.frombuffer(key[start * UNIT : end * UNIT], ">u8").reshape(-1, 3)[:, 2].astype(np.int64)


class Open:
    """A node of the stack: what is known of it and of what lies below it, in this partition."""

    __slots__ = ("depth", "n", "least", "children", "leaves", "a", "b", "below", "shared", "counted")

    def __init__(self, depth: int, shared: bool = False, counted: bool = False):
        self.depth, self.n, self.least, self.children, self.leaves, self.a, self.b = depth, 0, None, 0, 0, 0, 0
        self.below, self.shared, self.counted = False, shared, counted

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class Patricia:
    """Builds the compressed tree of the sorted keys of one partition. ``rows`` are the nodes that are over."""

    def __init__(self, before: bytes | None, after: bytes | None):
        self.before, self.after, self.last, self.stack, self.rows = before, after, None, [], []

    def add(self, key: bytes, n: int, least: int) -> None:
        if self.last is None:
            same = common_units(self.before, key) if self.before is not None else 0
            self.stack = [Open(d, True, self.before is not None) for d in range(same + 1)]
        else:
            self._leave(common_units(self.last, key))
        self.last = key
        depth = len(key) // UNIT
        if self.stack[-1].depth < depth:
            self.stack.append(Open(depth))
        self.stack[-1].add(n, least)

    def _leave(self, depth: int) -> None:
        """Close what is deeper; there is a node at this depth afterwards if something was."""
        while self.stack[-1].depth > depth:
            node = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Open(depth))
            self._close(node, self.stack[-1])

    def finish(self) -> None:
        same = common_units(self.last, self.after) if self.after is not None else 0
        if self.after is not None and same * UNIT == len(self.last):
            self.stack[-1].below = True  # the next partition goes on from the last key
        self._leave(same)
        while len(self.stack) > 1:
            node = self.stack.pop()
            node.shared = True
            if self.stack[-1].depth < node.depth - 1:
                self.stack.append(Open(node.depth - 1))
            self._close(node, self.stack[-1])
        self.stack[0].shared = True
        self._close(self.stack.pop(), None)

    def _close(self, node: Open, parent: Open | None) -> None:
        top = parent.depth if parent else 0
        words = unit_words(self.last, top, node.depth) if parent else np.zeros(1, np.int64)
        leaves = node.leaves if node.below else 1
        own, edge = int(words[-1]), int(words.sum())
        self.rows.append(
            (
                hashlib.md5(self.last[: node.depth * UNIT]).digest(),
                hashlib.md5(self.last[: top * UNIT]).digest() if parent else None,
                node.depth, node.n, node.least, node.children, leaves,
                node.a + node.n * own, node.b + (0 if node.counted else own),
                np.cumsum(words[::-1])[::-1], node.shared,
            )
        )
        if parent:
            parent.add(node.n, node.least)
            parent.below = True
            parent.children += not node.counted
            parent.leaves += leaves
            parent.a += node.a + node.n * edge
            parent.b += node.b + (0 if node.counted else edge)


NODES = {
    "node": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "n": pa.int64(), "least": pa.int64(), "children": pa.int64(),
    "leaves": pa.int64(), "a": pa.int64(), "b": pa.int64(), "suffix": pa.list_(pa.int64()), "shared": pa.bool_(),
}


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NODES)
    return record_batch({name: (list(c), kind) for (name, kind), c in zip(NODES.items(), columns, strict=True)})


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, flag, key, n, least, before, after) in order; the first row of each part has its neighbours."""
    tree = None
    for batch in batches:
        for flag, key, n, least, before, after in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if flag == 0:
                if tree:
                    tree.finish()
                    yield _node_batch(tree.rows)
                tree = Patricia(before, after)
                continue
            tree.add(key, n, least)
            if len(tree.rows) >= 10_000:
                yield _node_batch(tree.rows)
                tree.rows.clear()
    if tree:
        tree.finish()
        yield _node_batch(tree.rows)


def compressed(keys: DataFrame) -> DataFrame:
    """The nodes of the compressed tree of keys (conv_id, key), those that partitions share put together."""
    each = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ordered = each.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    parts = materialize(ordered, "sorted-keys")
    edges = parts.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    w = Window.orderBy("part")  # a row for each partition
    none, number = F.lit(None).cast("binary"), F.lit(None).cast("long")
    heads = edges.select("part", F.lit(0).alias("flag"), none.alias("key"), number.alias("n"), number.alias("least"), F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    rows = heads.union(parts.select("part", F.lit(1), "key", "n", "least", none, none))
    bound_batches(keys.sparkSession)
    built = rows.repartition("part").sortWithinPartitions("part", "flag", "key").mapInArrow(
        _build,
        "node binary, parent binary, depth long, n long, least long, children long, leaves long, a long, b long, suffix array<long>, shared boolean",
    )
    nodes = materialize(built, "nodes")
    discard(parts)
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "a", "b")]
    shared = nodes.filter("shared").withColumn("own", F.get("suffix", F.lit(0))).groupBy("node", "parent", "depth", "own").agg(F.sum("n").alias("n"), F.min("least").alias("least"), *sums)
    columns = ["node", "parent", "depth", "n", "least", "children", "leaves", "a", "b", "suffix"]
    whole = materialize(nodes.filter("NOT shared").select(*columns).union(shared.withColumn("suffix", F.array("own")).select(*columns)), "compressed")
    discard(nodes)
    return whole


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) of rows (node, conv_id) in order."""
    node, running = None, None
    for batch in batches:
        done = []
        for x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x != node:
                if running:
                    done.append((node, running.hexdigest()))
                node, running = x, hashlib.sha256(b"%d" % c)
            else:
                running.update(b",%d" % c)
        yield record_batch({"node": ([d[0] for d in done], pa.binary()), "ends": ([d[1] for d in done], pa.string())})
    if running:
        yield record_batch({"node": ([node], pa.binary()), "ends": ([running.hexdigest()], pa.string())})


def prefix_trie(turns: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node."""
    keys = materialize(sequences(turns, period, heads), "conversation-keys")
    tree = compressed(keys)
    ended = keys.select(F.unhex(F.md5("key")).alias("node"), "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = ended.mapInArrow(_hash_ends, "node binary, ends string")
    above = tree.select(F.col("node").alias("parent"), F.col("least").alias("parent_least"))
    met = tree.join(ends, "node", "left").join(above, "parent", "left")
    each = met.select("*", F.posexplode("suffix").alias("at", "words"))
    last = F.col("at") == F.size("suffix") - 1
    return each.select(
        F.col("least").alias("conv_id"),
        (F.col("depth") - F.size("suffix") + 1 + F.col("at")).alias("depth"),
        F.when(F.col("at") == 0, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("a") - F.col("b") + (F.col("n") - 1) * (F.col("words") - F.element_at("suffix", -1))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
