"""Exact n-gram Jaccard join by signature trees.

1. ``shingle_sets``: each text becomes the set of its word n-grams, as 64-bit hashes; equal sets are one class.
2. A class whose tokens mostly occur in no other class has a maximum possible overlap below the limit and goes.
   This is counted first on a fixed share of the token space (``SHARE``), then on all tokens of what is left.
3. What is left falls into families: classes that share a token among their rarest ones, which every linked
   pair must (prefix filter). Families are connected components, so no pair is lost.
4. Each family is cut into nodes of bounded size. Inside a node and between node pairs a signature tree is
   traversed: tree nodes hold OR-combined token bitmaps and size ranges, pairs of tree nodes whose maximum
   possible overlap is too low go, what reaches the leaves is verified on the full sets. Pairs that are known
   to be connected are not verified again, so a group of n near copies costs about n checks, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .common import RunHash, Words, batch_of, lists, mix, ranked, signed, slices, starts_of
from .components import components

#: Share of the token space (1 / 2**SHARE_BITS) that the first overlap bound looks at.
SHARE_BITS = 2
#: Tokens that one node holds at most, unless a single set is larger.
NODE_TOKENS = 1_000_000
#: Width of a size class inside a large family, as a share of the logarithm of the limit.
LEVELS = 2
LEAF = 16


def token_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, their bounds by text, and a 64-bit key of each set.

    ASCII letters are lower-cased. A text of fewer than ``n`` words has its whole sequence as one token; a text
    without words has none, and key 0.
    """
    words = Words(texts, lower=True)
    runs = RunHash(words.hash)
    first, bounds = starts_of(words, n)
    counts = np.diff(words.at)
    short = np.flatnonzero((counts > 0) & (counts < n))
    owner = np.concatenate((np.repeat(np.arange(len(texts)), np.diff(bounds)), short))
    token = np.concatenate((runs(first, first + n), runs(words.at[short], words.at[short + 1])))
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    if len(token):
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
        owner, token = owner[fresh], token[fresh]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    sizes = np.diff(bounds).astype(np.uint64)
    return token, bounds, np.where(sizes > 0, mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ sizes), np.uint64(0))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(id, ord, tid, n_shingles, key, tokens)``: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            token, bounds, key = token_sets(b.column("text").to_pylist(), n)
            yield batch_of(
                id=b.column("id"), ord=b.column("ord"), tid=b.column("tid"), n_shingles=pa.array(np.diff(bounds), pa.int64()),
                key=pa.array(signed(key)), tokens=lists(signed(token), bounds, pa.int64()),
            )

    return ranked(docs, id_col, text_col).mapInArrow(
        run, "id long, ord long, tid long, n_shingles long, key long, tokens array<long>"
    )


def shared_tokens(docs: DataFrame, n: int) -> DataFrame:
    """``(token, key)`` of the tokens in the looked-at share of the token space, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            token, bounds, key = token_sets(b.column("text").to_pylist(), n)
            seen = token >> np.uint64(64 - SHARE_BITS) == 0
            yield batch_of(token=pa.array(signed(token[seen])), key=pa.array(signed(np.repeat(key, np.diff(bounds))[seen])))

    return docs.select("text").mapInArrow(run, "token long, key long")


def needed(size: np.ndarray | int, percent: int):
    """Least overlap that a set of ``size`` needs with any partner."""
    return -(-size * percent // 100)


def survivors(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """``(key, n_shingles, tokens)`` of the classes whose possible overlap with others reaches the limit."""
    lone = (
        shared_tokens(docs, n)
        .groupBy("token")
        .agg(F.min("key").alias("key"), F.max("key").alias("last"))
        .where("key = last")
        .groupBy("key")
        .agg(F.count("*").alias("lone"))
    )
    classes = sets.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("ord", "tid", "n_shingles")).alias("c"))
    room = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100)
    kept = (
        classes.select("key", "c.*")
        .join(lone, "key", "left")
        .where(F.coalesce("lone", F.lit(0)) <= room)
        .select("ord", "tid")
    )
    full = shingle_sets(docs.join(kept, ["ord", "tid"], "left_semi"), "ord", "text", n)
    return written(full.select("key", "n_shingles", "tokens"), "sets")


def families(sets: DataFrame, percent: int) -> DataFrame:
    """``(key, family)``: classes connected by a token that is among the rarest of both."""
    tokens = sets.dropDuplicates(["key"]).select("key", "n_shingles", F.explode("tokens").alias("token"))
    tokens = written(tokens, "tokens")
    spread = tokens.groupBy("token").agg(F.count("*").alias("spread"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("spread", "token"))
    prefix = tokens.join(spread, "token").select("key", "token", "spread", "n_shingles", rank.alias("rank"))
    prefix = prefix.where(F.col("rank") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1)
    prefix = written(prefix.where("spread > 1").select("key", "token"), "prefix")
    links = prefix.join(prefix.groupBy("token").agg(F.min("key").alias("least")), "token").select("key", "least")
    return components(links).withColumnsRenamed({"node": "key", "label": "family"})


class Tree:
    """Signature tree over sets in order of size: level 0 holds the sets, each level above groups of ``LEAF``."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        size = np.array([len(s) for s in sets])
        bits = 1 << int(np.clip(np.ceil(np.log2(max(64, 2 * size.max()))), 6, 15))
        maps = np.zeros((len(sets), bits), bool)
        for row, s in zip(maps, sets):
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(maps, axis=1).view(np.uint64)
        ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: by level: bitmaps, least and greatest size, least (bits - size) of the members
        self.levels = [(maps, size, size, ones - size)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(maps), LEAF)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                np.minimum.reduceat(slack, cuts),
            ))


def possible(one: Tree, i: int, a: np.ndarray, other: Tree, j: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes ``a`` of level ``i`` may hold partners of nodes ``b`` of level ``j``, pair by pair.

    A set of size x with p bits has at least p - |common bits| tokens of its own, so its overlap is at most
    (x - p) + |common bits|; the greatest of (x - p) and the common bits of the combined maps bound it for a node.
    """
    maps, low, high, slack = (x[a] for x in one.levels[i])
    maps2, low2, high2, slack2 = (x[b] for x in other.levels[j])
    fits = (100 * high >= percent * low2) & (100 * high2 >= percent * low)
    common = np.bitwise_count(maps & maps2).sum(axis=1, dtype=np.int64)
    most = common - np.maximum(slack, slack2)
    return fits & (most >= needed(np.maximum(low, low2), percent)) & (most * (100 + percent) >= percent * (low + low2))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class Labels:
    """Which sets are known to be connected."""

    def __init__(self, given: list):
        first: dict = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(given)])

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.of(i), self.of(j)
        self.up[max(i, j)] = min(i, j)


def traverse(one: Tree, other: Tree, labels: Labels, shift: int, percent: int) -> list[tuple[int, int]]:
    """New links between sets of ``one`` and of ``other``; the latter's labels start at ``shift`` (0: one tree)."""
    found = []
    stack = [(len(one.levels) - 1, 0, len(other.levels) - 1, 0)]
    while stack:
        i, a, j, b = stack.pop()
        if i == j == 0:
            if labels.of(a) != labels.of(b + shift):
                x, y = one.sets[a], other.sets[b]
                both = overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    labels.link(a, b + shift)
                    found.append((a, b + shift))
            continue
        kids_a = np.arange(a * LEAF, min((a + 1) * LEAF, len(one.levels[i - 1][0]))) if i else np.array([a])
        kids_b = np.arange(b * LEAF, min((b + 1) * LEAF, len(other.levels[j - 1][0]))) if j else np.array([b])
        i, j = max(0, i - 1), max(0, j - 1)
        x, y = (g.ravel() for g in np.meshgrid(kids_a, kids_b, indexing="ij"))
        if one is other:
            ordered = x < y if i == 0 else x <= y
            x, y = x[ordered], y[ordered]
        if i == j == 0:
            apart = np.array([labels.of(p) != labels.of(q + shift) for p, q in zip(x, y)], bool)
            x, y = x[apart], y[apart]
        if len(x):
            may = possible(one, i, x, other, j, y, percent)
            # the last pushed is taken first: near neighbours in order of size before distant ones
            stack += [(i, int(p), j, int(q)) for p, q in sorted(zip(x[may], y[may]), key=lambda k: -abs(k[0] - k[1]))]
    return found


def _sets(lists_: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(np.uint64) for x in lists_]


def inside(nodes: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` found inside each ``(family, node)`` of ``(family, node, key, label, n_shingles, tokens)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values(["n_shingles", "key"])
        tree, keys = Tree(_sets(pdf["tokens"])), pdf["key"].to_numpy()
        pairs = traverse(tree, tree, Labels(list(pdf["label"])), 0, percent)
        return pd.DataFrame({"a": [keys[i] for i, _ in pairs], "b": [keys[j] for _, j in pairs]}, dtype="int64")

    return nodes.groupBy("family", "node").applyInPandas(run, "a long, b long")


def between(pairs: DataFrame, percent: int) -> DataFrame:
    """Links found between the two nodes of each ``pair`` of ``(pair, side, key, label, n_shingles, tokens)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "n_shingles", "key"])
        keys, n = pdf["key"].to_numpy(), int((pdf["side"] == 0).sum())
        trees = [Tree(_sets(pdf["tokens"].iloc[:n])), Tree(_sets(pdf["tokens"].iloc[n:]))]
        found = traverse(*trees, Labels(list(pdf["label"])), n, percent)
        return pd.DataFrame({"a": [keys[i] for i, _ in found], "b": [keys[j] for _, j in found]}, dtype="int64")

    return pairs.groupBy("pair").applyInPandas(run, "a long, b long")


def relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).withColumnsRenamed({"node": "key", "label": "new"})
    return nodes.join(labels, "key", "left").withColumn("label", F.coalesce("new", "key")).drop("new")


def tree_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between class keys that connect exactly what the limit connects.

    Families of up to ``NODE_TOKENS`` tokens are one node. Larger ones are cut by size class and hash; after the
    nodes themselves, one set of each connected group meets those of the others, then all node pairs that hold
    different groups and may overlap.
    """
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / (-np.log(percent / 100) / LEVELS)).cast("int")
    members = sets.dropDuplicates(["key"]).join(families(sets, percent), "key").withColumn("level", level)
    members = written(members, "members")
    sums = members.groupBy("family", "level").agg(F.sum("n_shingles").alias("part"))
    sums = sums.withColumn("whole", F.sum("part").over(Window.partitionBy("family")))
    sums = written(sums, "sums")
    chunk = F.pmod("key", F.ceil(F.col("part") / NODE_TOKENS))
    node = F.when(F.col("whole") > NODE_TOKENS, F.concat_ws("/", "level", chunk)).otherwise("")
    nodes = members.join(sums, ["family", "level"]).withColumn("node", node).withColumn("label", F.col("key"))
    nodes = written(nodes.drop("part"), "nodes")
    links = written(inside(nodes, percent), "links")

    large = nodes.where(F.col("whole") > NODE_TOKENS)
    if large.limit(1).count() == 0:
        return links
    large = written(relabel(large, links), "large")
    heads = large.where("label = key")
    total = heads.groupBy("family").agg(F.sum("n_shingles").alias("heads"))
    heads = heads.join(total, "family").withColumn("node", F.pmod("key", F.ceil(F.col("heads") / NODE_TOKENS)).cast("string"))
    links = written(links.union(inside(heads, percent)), "links")
    large = written(relabel(large.drop("label"), links), "large")
    kinds = large.groupBy("family", "node", "level").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"),
    )
    kinds = written(kinds, "kinds")
    x, y = kinds.alias("x"), kinds.alias("y")
    meets = (
        (F.col("x.family") == F.col("y.family"))
        & (F.col("x.node") < F.col("y.node"))
        & (100 * F.col("x.most") >= percent * F.col("y.least"))
        & (100 * F.col("y.most") >= percent * F.col("x.least"))
        & ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    )
    pairs = x.join(y, meets).select(
        F.concat_ws(" ", "x.family", "x.node", "y.node").alias("pair"),
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("side"), F.col(f"{s}.family").alias("family"), F.col(f"{s}.node").alias("node")) for i, s in enumerate("xy")
        ])).alias("end"),
    ).select("pair", "end.*")
    return written(links.union(between(pairs.join(large, ["family", "node"]), percent)), "links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(id, ord, tid, n_shingles, class_key, group_key, component_id)`` for every row of ``docs``.

    Two rows link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word ``n``-grams; ``component_id`` is
    the least id reached by links. Empty and null texts have no tokens and link with nothing. Rows of equal sets are
    one class, however many. A null id orders after all others and never names a group that has another id. Repeated
    ids stay separate rows that share an id: ``group_key`` tells groups apart, also those of one id or of none, and is null
    without words. Tokens are 64-bit hashes. An empty table gives no rows.
    """
    rows = ranked(docs, id_col, text_col)
    sets = shingle_sets(docs, id_col, text_col, n).drop("tokens")
    sets = written(sets, "keys")
    links = tree_links(survivors(rows, sets, n, percent), percent)
    classes = sets.where("n_shingles > 0").groupBy("key").agg(F.min("ord").alias("first"))
    labels = components(links).withColumnsRenamed({"node": "key"})
    classes = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    classes = written(classes, "classes")
    groups = classes.groupBy("label").agg(F.min("first").alias("least"))
    named = written(classes.join(groups, "label").select("key", "label", "least"), "named")
    out = sets.join(named, "key", "left")
    least = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("ord"))
    own = F.when(least == F.lit(2**63 - 1), F.col("id")).otherwise(least)
    group = F.when(F.col("n_shingles") > 0, F.col("label"))
    return out.select(
        "id", "ord", "tid", "n_shingles", F.col("key").alias("class_key"), group.alias("group_key"), own.alias("component_id")
    )
