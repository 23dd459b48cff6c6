"""Prefix trie of conversations: ternary search trees by range shard, joined at the nodes that shards may share.

1. ``numbered_turns`` orders the turns of each conversation; ``dictionary`` gives each distinct turn a number.
2. ``distinct_paths`` turns conversations into paths of turn numbers and counts equal paths once; the digest of a path's
   conversations is made from sorted runs of ids, so the task that ends a hot path reads runs and not ids.
3. ``shard_nodes`` deals paths by range of their first ``LEAD`` turns. Each shard builds a ternary search tree, the median
   path first, then the medians of both halves, and sums members, leaves and savings over it without recursion.
4. A node that another shard may hold too lies on the first or the last lead of its shard, or below one that is ``LEAD`` deep.
   Such nodes are added up by path; their subtree sums are made by doubling: in each round a node takes over the sums of those
   that hang on it and then hangs on what its holder hung on, so the number of rounds is the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import blocks_of, written
from .common import mix

WORD = r"([^\x20\x09-\x0D]+)"
#: Turns by which paths are dealt to shards; bounds what range sampling brings to the driver.
LEAD = 16
#: Turns of distinct paths that a shard holds, about.
SHARD_TURNS = 500_000
#: Bytes of ids in one run of the digest.
RUN_BYTES = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, h1, h2, words)`` of ``(conv_id, turn, role, text)``: ``pos`` counts from 1 in order of turn.

    Null turns come first; equal turns are ordered by role, then text. Null roles and texts are empty. Rows without a
    conversation belong to none and are left out. Two 64-bit hashes name a turn by role and text.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    return rows.select(
        "conv_id", pos.alias("pos"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"),
        words.cast("bigint").alias("words"),
    )


def dictionary(turns: DataFrame) -> DataFrame:
    """``(h1, h2, code)``: a number for each distinct turn. Written once, so that a repeated task cannot number anew."""
    return written(turns.select("h1", "h2").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")


def paths(turns: DataFrame, rebuild: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(conv_id, path)``: the turns of each conversation as structs ``(code, words)``, one array of 16 bytes a turn."""
    turns = written(numbered_turns(turns), "turns")
    coded = turns.join(dictionary(turns), ["h1", "h2"]).select("conv_id", F.struct("pos", "code", "words").alias("turn"))
    lists = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("path"))
    lists = lists.withColumn("path", F.transform("path", lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words"))))
    return rebuild(lists) if rebuild else lists


def shared_heads(lists: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Each path with its first ``head`` turns replaced by the first turns of the conversation ``base``.

    A base that is absent gives none, one that is shorter gives all. ``longest`` bounds ``head``, so that a base sends no more.
    """
    bases = lists.select(F.col("conv_id").alias("base"), F.slice("path", 1, longest).alias("top"))
    rows = lists.select("conv_id", "path", base.alias("base"), head.cast("int").alias("head"))
    own = F.expr("slice(path, head + 1, size(path))")
    top = F.expr("slice(top, 1, head)")
    joined = rows.join(bases.join(rows.select("base").distinct(), "base", "left_semi"), "base", "left")
    return joined.select("conv_id", F.when(F.col("top").isNull(), own).otherwise(F.concat(top, own)).alias("path"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one path from rows ``(k1, k2, conv_id)`` in this order: ``(k1, k2, first, n, ids)``."""
    key, ids, size = None, [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "k1": pa.array([key[0]], pa.int64()), "k2": pa.array([key[1]], pa.int64()), "first": pa.array([ids[0]], pa.int64()),
            "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([",".join(map(str, ids)).encode()], pa.binary()),
        })

    done: list[pa.RecordBatch] = []
    for b in batches:
        for k1, k2, conv in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
            if ids and (key != (k1, k2) or size > RUN_BYTES):
                done.append(close())
                ids, size = [], 0
            key = (k1, k2)
            ids.append(conv)
            size += 12
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if ids:
        yield close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k1, k2, least, copies, ends)`` from runs in order of path and first id; one hash state is held at a time."""
    key, state, least, copies = None, None, 0, 0
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*done)
        kinds = [("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("copies", pa.int64()), ("ends", pa.string())]
        return pa.RecordBatch.from_pydict({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns)})

    for b in batches:
        for k1, k2, first, n, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "first", "n", "ids"))):
            if key == (k1, k2):
                state.update(b",")
            else:
                if key:
                    done.append((*key, least, copies, state.hexdigest()))
                key, state, least, copies = (k1, k2), hashlib.sha256(), first, 0
            state.update(ids)
            copies += n
        if done:
            yield batch()
            done = []
    if key:
        done.append((*key, least, copies, state.hexdigest()))
        yield batch()


def distinct_paths(lists: DataFrame) -> DataFrame:
    """``(path, least, copies, ends)``: each distinct path once, with the SHA-256 of its sorted ids and their least."""
    keyed = lists.select(
        "conv_id", "path", F.xxhash64("path.code").alias("k1"), F.xxhash64(F.lit(1), "path.code", F.size("path")).alias("k2")
    )
    keyed = written(keyed, "paths")
    width = blocks_of(lists.sparkSession)
    ids = keyed.select("k1", "k2", "conv_id").repartitionByRange(width, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    runs = ids.mapInArrow(_runs, "k1 long, k2 long, first long, n long, ids binary")
    runs = runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    ends = written(runs.mapInArrow(_digests, "k1 long, k2 long, least long, copies long, ends string"), "ends")
    return keyed.join(ends.withColumn("conv_id", F.col("least")), ["k1", "k2", "conv_id"]).select("path", "least", "copies", "ends")


def medians(n: int) -> Iterator[int]:
    """The numbers below ``n``: the middle one first, then those of both halves, and so on."""
    spans = [(0, n)]
    for low, high in spans:
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(low, middle), (middle + 1, high)]


class Ternary:
    """Ternary search tree over paths of turn numbers; node 0 is the root of the trie and holds no turn.

    ``less`` and ``more`` lead to siblings of lower and higher turn number, ``down`` to the first turn that follows.
    """

    def __init__(self) -> None:
        self.code, self.less, self.more, self.down = [-1], [0], [0], [0]
        self.up, self.depth, self.words = [-1], [0], [0]
        self.members, self.least, self.ends = [0], [None], [None]

    def _node(self, code: int, words: int, up: int) -> int:
        for column, value in (
            (self.code, code), (self.less, 0), (self.more, 0), (self.down, 0), (self.up, up), (self.depth, self.depth[up] + 1),
            (self.words, words), (self.members, 0), (self.least, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.code) - 1

    def find(self, up: int, code: int, words: int) -> int:
        """The child of ``up`` with this turn, made where there is none."""
        at = self.down[up]
        if not at:
            self.down[up] = at = self._node(code, words, up)
        while self.code[at] != code:
            side = self.less if code < self.code[at] else self.more
            if not side[at]:
                side[at] = self._node(code, words, up)
            at = side[at]
        return at

    def insert(self, codes: list[int], words: list[int], least: int, copies: int, ends: str) -> None:
        at = 0
        for code, count in zip([None, *codes], [0, *words]):
            if code is not None:
                at = self.find(at, code, count)
            self.members[at] += copies
            self.least[at] = least if self.least[at] is None else min(least, self.least[at])
        self.ends[at] = ends

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the path of each node; the same in every shard."""
        one, two = np.zeros(len(self.code), np.uint64), np.zeros(len(self.code), np.uint64)
        code, up, depth = np.array(self.code, np.int64).view(np.uint64), np.array(self.up), np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        starts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for level in range(1, depth.max() + 1):
            at = order[starts[level] : starts[level + 1]]
            one[at] = mix(mix(one[up[at]] + _STEP) ^ code[at])
            two[at] = mix(mix(two[up[at]] + _OTHER) ^ (code[at] * _STEP))
        return one.view(np.int64), two.view(np.int64)

    def boundary(self, leads: list[list[int]]) -> list[bool]:
        """Which nodes another shard may hold too, given the first and the last lead of this one."""
        on, full = {0}, set()
        for lead in leads:
            at = 0
            for code in lead:
                at = self.find(at, code, 0)
                on.add(at)
            if len(lead) == LEAD:
                full.add(at)
        out = []
        for node in range(len(self.code)):
            if node and node not in on and self.up[node] in full:
                on.add(node)
                full.add(node)
            out.append(node in on)
        return out

    def sums(self, boundary: list[bool]) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and savings: of the whole subtree where it is the shard's own, else of its own children's subtrees.

        A node is made after the one above it, so going backwards every subtree is complete when it is handed up.
        """
        n = len(self.code)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for node in range(n - 1, 0, -1):
            if boundary[node]:
                continue
            leaves[node] += not children[node]
            saved[node] += (self.members[node] - 1) * self.words[node]
            up = self.up[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        return children, leaves, saved


NODE = (
    "k1 long, k2 long, up1 long, up2 long, depth long, least long, up_least long, n long, words long, children long, leaves long, "
    "saved long, ends string, shared boolean, under_shared boolean"
)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the paths of one shard, which come in order of their leads."""
    rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("code", "words", "least", "copies", "ends")))]
    if not rows:
        return
    leads = [rows[0][0][:LEAD], rows[-1][0][:LEAD]]
    rows.sort(key=lambda row: row[0])
    tree = Ternary()
    for i in medians(len(rows)):
        tree.insert(*rows[i])
    shared = tree.boundary(leads)
    children, leaves, saved = tree.sums(shared)
    k1, k2 = tree.keys()
    up = np.maximum(np.array(tree.up), 0)
    root = np.array(tree.up) < 0
    for at in range(0, len(k1), 10_000):
        to = slice(at, at + 10_000)
        yield pa.RecordBatch.from_pydict({
            "k1": pa.array(k1[to]), "k2": pa.array(k2[to]), "up1": pa.array(k1[up[to]], mask=root[to]), "up2": pa.array(k2[up[to]], mask=root[to]),
            "depth": pa.array(tree.depth[to], pa.int64()), "least": pa.array(tree.least[to], pa.int64()),
            "up_least": pa.array([None if p < 0 else tree.least[p] for p in tree.up[to]], pa.int64()), "n": pa.array(tree.members[to], pa.int64()),
            "words": pa.array(tree.words[to], pa.int64()), "children": pa.array(children[to], pa.int64()), "leaves": pa.array(leaves[to], pa.int64()),
            "saved": pa.array(saved[to], pa.int64()), "ends": pa.array(tree.ends[to], pa.string()), "shared": pa.array(shared[to]),
            "under_shared": pa.array([p >= 0 and shared[p] for p in tree.up[to]]),
        })


def shard_nodes(found: DataFrame) -> DataFrame:
    """Nodes of all shards; ``shared`` ones are not complete and may occur in several."""
    found = written(found.select("path.code", "path.words", "least", "copies", "ends"), "distinct")
    turns = found.agg(F.sum(F.size("code"))).first()[0] or 0
    shards = max(blocks_of(found.sparkSession), -(-turns // SHARD_TURNS))
    lead = F.slice("code", 1, LEAD)
    dealt = found.withColumn("lead", lead).withColumn("path_hash", F.xxhash64("code"))
    dealt = dealt.repartitionByRange(shards, "lead", "path_hash").sortWithinPartitions("lead", "path_hash")
    return written(dealt.select("code", "words", "least", "copies", "ends").mapInArrow(_shard, NODE), "nodes")


def merged_boundary(nodes: DataFrame) -> DataFrame:
    """The shared nodes, each once and complete: what shards hold of it is added up, then subtrees by doubling."""
    parts = nodes.where("shared").groupBy("k1", "k2").agg(
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("depth").alias("depth"), F.min("least").alias("least"),
        F.sum("n").alias("n"), F.max("words").alias("words"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")],
    )
    parts = written(parts, "boundary")
    inner = parts.where("up1 is not null").groupBy(F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count("*").alias("inner"))
    parts = parts.join(inner, ["k1", "k2"], "left").withColumn("children", F.col("children") + F.coalesce("inner", F.lit(0)))
    parts = parts.withColumn("leaves", F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
    parts = parts.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words")).drop("inner", "words")
    parts = written(parts, "boundary")
    sums = written(parts.select("k1", "k2", "leaves", "saved", F.col("up1").alias("to1"), F.col("up2").alias("to2")), "sums")
    while sums.where("to1 is not null").limit(1).count():
        gain = sums.where("to1 is not null").groupBy(F.col("to1").alias("k1"), F.col("to2").alias("k2"))
        gain = gain.agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        hop = sums.select(F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.col("to1").alias("next1"), F.col("to2").alias("next2"))
        sums = sums.join(gain, ["k1", "k2"], "left").join(hop, ["to1", "to2"], "left").select(
            "k1", "k2", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("most", F.lit(0))).alias("saved"),
            F.col("next1").alias("to1"), F.col("next2").alias("to2"),
        )
        sums = written(sums, "sums")
    above = parts.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("least").alias("up_least"))
    return parts.drop("leaves", "saved").join(sums.drop("to1", "to2"), ["k1", "k2"]).join(above, ["up1", "up2"], "left")


def prefix_trie(turns: DataFrame, rebuild: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each node of the trie of the conversations ``(conv_id, turn, role, text)``, the root included.

    ``(least, depth, up_least, n, children, leaves, saved, ends)``: smallest member, turns, smallest member of the node above
    (null at the root), members, child nodes, childless nodes in the subtree, words that members need not repeat in the
    subtree, SHA-256 of the sorted ids of the members that end here. ``rebuild`` may change the paths ``(conv_id, path)`` before.
    A path without turns belongs to the root alone. No conversations give no rows, not even a root. Columns besides
    the four are not read. One conversation is one array in a task, of 16 bytes a turn.
    """
    nodes = shard_nodes(distinct_paths(paths(turns, rebuild)))
    shared = written(merged_boundary(nodes), "merged")
    columns = ["least", "depth", "up_least", "n", "children", "leaves", "saved", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")]
    own = nodes.where("not shared")
    inside = own.where("not under_shared")
    above = shared.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("least").alias("up_least"))
    under = own.where("under_shared").drop("up_least").join(above, ["up1", "up2"])
    return inside.select(columns).union(under.select(columns)).union(shared.select(columns))
