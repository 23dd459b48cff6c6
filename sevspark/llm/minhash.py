"""Near duplicates by circulant MinHash: banded signatures retrieve, full sets decide.

1. Each distinct set of word n-grams (a class) gets a signature of ``BANDS * ROWS`` coordinates from two permutations of
   the 64-bit hash space only: the first scatters the tokens, the second is applied after a circular shift by the
   coordinate's number, and the coordinate is the least value (``signatures``).
2. Classes that agree in all rows of a band share a bucket. In a first round every member of a bucket is held against one
   of them, so a bucket of n gives n - 1 pairs; links make components.
3. Where a bucket still holds several components, blocks of its members meet in tasks: bitmaps of the sets bound what two
   may share, and of the pairs that may reach the limit only the best few of each two components leave the task. They are
   verified, components grow, and the rounds go on with four times as many until nothing was held back. So all pairs of
   different components that share a bucket are decided, and pairs inside a component are never listed.

At the limit of 0.85 a link is missed by all 32 bands of 4 with a probability of (1 - 0.85**4)**32 = 1e-9, at 0.9 of 1e-14.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import LAST_ID, batch_of, lists, mix, ranked, signed, slices
from .components import components
from .jaccard_join import token_sets

BANDS, ROWS = 32, 4
#: Bytes of text of which signatures are made at once: the arrays of a coordinate stay in the processor's cache.
PART_BYTES = 1 << 19
#: Members of a bucket that one task holds on each side.
BLOCK = 512
#: Bits of the bitmap by which two sets are compared before their tokens are fetched.
BITS = 2048

_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def signatures(token: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each set; no set is empty."""
    scattered = mix(token ^ _FIRST)
    out = np.empty((len(bounds) - 1, size), np.uint64)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(mix((scattered - np.uint64(k)) ^ _SECOND), bounds[:-1])
    return out


def band_values(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each band of each signature; it also depends on the band's number."""
    bands = signature.shape[1] // rows
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
    for row in range(rows):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, row::rows][:, :bands])
    return value


def banded_sets(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """``(id, ord, tid, n_shingles, key, bands)``: one row per row of ``docs``; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PART_BYTES):
            token, bounds, key = token_sets(b.column("text").to_pylist(), n)
            sizes = np.diff(bounds)
            some = sizes > 0
            values = np.empty(0, np.uint64)
            if some.any():
                values = band_values(signatures(token, np.concatenate((bounds[:-1][some], bounds[-1:])), bands * rows), rows).ravel()
            ends = np.concatenate(([0], np.cumsum(some * bands)))
            yield batch_of(
                id=b.column("id"), ord=b.column("ord"), tid=b.column("tid"), n_shingles=pa.array(sizes, pa.int64()),
                key=pa.array(signed(key)), bands=lists(signed(values), ends, pa.int64()),
            )

    schema = "id long, ord long, tid long, n_shingles long, key long, bands array<long>"
    return ranked(docs, id_col, text_col).mapInArrow(run, schema)


def full_sets(rows: DataFrame, n: int) -> DataFrame:
    """``(key, n_shingles, ones, bitmap, tokens)`` of the rows ``(text)``; ``ones`` counts the bits of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            token, bounds, key = token_sets(b.column("text").to_pylist(), n)
            owner = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            maps = np.zeros((b.num_rows, BITS), bool)
            maps[owner, (mix(token) & np.uint64(BITS - 1)).astype(np.int64)] = True
            packed = np.packbits(maps, axis=1)
            yield batch_of(
                key=pa.array(signed(key)), n_shingles=pa.array(np.diff(bounds), pa.int64()), ones=pa.array(maps.sum(axis=1), pa.int64()),
                bitmap=pa.array([m.tobytes() for m in packed], pa.binary()), tokens=lists(signed(token), bounds, pa.int64()),
            )

    return rows.select("text").mapInArrow(run, "key long, n_shingles long, ones long, bitmap binary, tokens array<long>")


def may_match(x: str | Column, y: str | Column, percent: int) -> Column:
    """Whether two set sizes allow the limit."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    return (100 * x >= percent * y) & (100 * y >= percent * x)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose full sets reach the limit."""
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    other = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(one, "a").join(other, "b")
    return met.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def star_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of each member ``(value, key, n_shingles)`` of a bucket with the bucket's member of the least key."""
    heads = buckets.groupBy("value").agg(F.min(F.struct("key", "n_shingles")).alias("head"))
    met = buckets.join(heads, "value").where("key > head.key").where(may_match("n_shingles", "head.n_shingles", percent))
    return met.select(F.col("head.key").alias("a"), F.col("key").alias("b")).distinct()


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the ``label`` of the component that ``links`` give their key, its own key without links."""
    found = components(links).withColumnsRenamed({"node": "key"})
    return members.join(found, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _close(group: dict[str, np.ndarray], percent: int, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of one task that may match, and whether some were held back; see ``close_pairs``."""
    left = np.flatnonzero(group["side"] == 0)
    alone = len(left) == len(group["side"])
    right = left if alone else np.flatnonzero(group["side"] == 1)
    size, label, slack, maps, bands = (group[c] for c in ("n_shingles", "label", "slack", "bitmap", "bands"))
    number = group["band"][0]
    found = []
    for at, i in enumerate(left):
        j = right[at + 1 :] if alone else right
        j = j[(label[j] != label[i]) & (100 * size[j] >= percent * size[i]) & (100 * size[i] >= percent * size[j])]
        if len(j) and number:  # a pair that an earlier band brought together is that band's
            j = j[~(bands[j, :number] == bands[i, :number]).any(axis=1)]
        if not len(j):
            continue
        bound = np.bitwise_count(maps[j] & maps[i]).sum(axis=1, dtype=np.int64) + np.minimum(slack[i], slack[j])
        both = size[j] + size[i]
        fits = bound * (100 + percent) >= percent * both
        found += [(-x / n, i, k) for k, x, n in zip(j[fits], bound[fits], both[fits])]
    key, taken, held, out = group["key"], {}, False, []
    for _, i, j in sorted(found):
        ends = tuple(sorted((label[i], label[j])))
        taken[ends] = taken.get(ends, 0) + 1
        if taken[ends] > most:
            held = True
        else:
            out.append((min(key[i], key[j]), max(key[i], key[j])))
    return out, held


def close_pairs(tasks: DataFrame, percent: int, most: int) -> DataFrame:
    """``(value, a, b, cut)`` from rows ``(value, pair, side, ...)``: two blocks of a bucket, or one (``side`` 0 alone).

    Pairs of different labels whose bitmaps allow the limit, ``most`` at most of each two labels and task, the best bounded
    first; ``cut`` marks the pairs of a task that held some back. A set of x tokens and p bits shares at most
    (x - p) + (common bits) tokens. A Python task holds one pair of blocks and one Arrow batch.
    """

    def columns(t: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("value", "side", "band", "key", "label", "n_shingles", "slack")}
        out["bitmap"] = np.frombuffer(b"".join(t.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        out["bands"] = t.column("bands").flatten().to_numpy().reshape(t.num_rows, -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []

        def work(t: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
            all_, rows = columns(t), []
            for x, y in zip(cuts, cuts[1:]):
                pairs, held = _close({c: v[x:y] for c, v in all_.items()}, percent, most)
                rows += [(all_["value"][x], a, b, held) for a, b in pairs]
            value, a, b, held = zip(*rows) if rows else ((), (), (), ())
            return batch_of(value=pa.array(value, pa.int64()), a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), cut=pa.array(held, pa.bool_()))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*rest, b]).combine_chunks().to_batches()[0]
            value, pair = t.column("value").to_numpy(), t.column("pair").to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero((value[1:] != value[:-1]) | (pair[1:] != pair[:-1])) + 1))
            if len(cuts) > 1:  # the last task may go on in the next batch
                yield work(t.slice(0, cuts[-1]), cuts)
            rest = [t.slice(cuts[-1])]
        if rest:
            yield work(rest[0], np.array([0, rest[0].num_rows]))

    dealt = tasks.select("value", "pair", "side", "band", "key", "label", "n_shingles", "slack", "bitmap", "bands")
    dealt = dealt.repartition("value", "pair").sortWithinPartitions("value", "pair", "side", "n_shingles")
    return dealt.mapInArrow(run, "value long, a long, b long, cut boolean")


def block_pairs(members: DataFrame) -> DataFrame:
    """``members`` of unsettled buckets dealt to pairs of blocks: ``(value, pair, side, ...)``.

    A bucket of up to ``BLOCK`` members is one block. A larger one is cut by size, so that only blocks whose sizes are near
    meet, and by hash; with c blocks it sends a member to c tasks at most. Blocks of one and the same label do not meet.
    """
    totals = members.groupBy("value").agg(F.count("*").alias("total"))
    sized = members.join(totals, "value").withColumn("level", F.when(F.col("total") > BLOCK, F.col("level")).otherwise(0))
    counts = sized.where(F.col("total") > BLOCK).groupBy("value", "level").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK))
    blocks = sized.join(counts, ["value", "level"], "left").withColumn("block", F.concat_ws("/", "level", chunk))
    blocks = written(blocks.drop("n", "total"), "blocks")
    kinds = blocks.groupBy("value", "block", "level").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    kinds = written(kinds, "kinds")
    x, y = kinds.alias("x"), kinds.alias("y")
    one_label = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    near = F.abs(F.col("x.level") - F.col("y.level")) <= 1
    meet = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.block") <= F.col("y.block")) & near & ~one_label)
    ends = F.when(F.col("x.block") == F.col("y.block"), F.array(F.struct(F.lit(0).alias("side"), F.col("x.block").alias("block"))))
    ends = ends.otherwise(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"{s}.block").alias("block")) for i, s in enumerate("xy")]))
    dealt = meet.select("x.value", F.concat_ws(" ", "x.block", "y.block").alias("pair"), F.explode(ends).alias("end"))
    return dealt.select("value", "pair", "end.*").join(blocks, ["value", "block"])


def bucket_links(classes: DataFrame, sets: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the classes which pairs of one bucket at the limit connect."""
    links = written(verified(written(star_pairs(buckets, percent), "stars"), sets, percent), "links")
    # a level spans a ratio of the limit: sizes that may match are at most one level apart
    width = -np.log(min(percent, 99) / 100) * (1 + 1e-6)
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / width).cast("int").alias("level")
    maps = sets.select("key", "bitmap", (F.col("n_shingles") - F.col("ones")).alias("slack"), level)
    most = 1
    while True:
        placed = written(labelled(buckets, links), "placed")
        open_ = placed.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        members = placed.join(open_.select("value"), "value", "left_semi")
        members = written(members.join(maps, "key").join(classes.select("key", "bands"), "key"), "members")
        if members.limit(1).count() == 0:
            return links
        found = written(close_pairs(block_pairs(members), percent, most), "close")
        links = written(links.union(verified(found.select("a", "b").distinct(), sets, percent)), "links")
        cut = found.where("cut").select("value").distinct()
        if cut.limit(1).count() == 0:
            return links
        # a bucket that gave all its pairs is settled
        buckets, most = written(buckets.join(cut, "value", "left_semi"), "buckets"), most * 4


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(id, ord, tid, n_shingles, class_key, group_key, component_id, kept)`` for every row of ``docs``.

    Two rows link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word ``n``-grams (ASCII letters lower-cased; fewer
    words: the whole sequence is the one n-gram). ``component_id`` is the least id that links reach, ``kept`` marks the rows that
    bear it. Empty and null texts have no tokens and link with nothing. Equal sets are one class, however many rows. A null id
    orders after all others; ``group_key`` tells groups apart whose ids are repeated or null, and is null without words.
    Other columns are not read; an empty table gives no rows. Tokens are 64-bit hashes.
    """
    sets = written(banded_sets(docs, id_col, text_col, n, bands, rows), "sets")
    # rows of equal sets have the same bands
    classes = sets.where("n_shingles > 0").groupBy("key").agg(
        F.min(F.struct("ord", "tid")).alias("first"), F.min("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = written(classes.select("key", "first.*", "n_shingles", "bands"), "classes")
    spread = classes.select("key", "n_shingles", F.posexplode("bands").alias("band", "value"))
    shared = spread.groupBy("value").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    buckets = written(spread.join(shared.select("value"), "value", "left_semi"), "buckets")
    heads = classes.join(buckets.select("key").distinct(), "key", "left_semi").select("ord", "tid")
    text = ranked(docs, id_col, text_col).join(heads, ["ord", "tid"], "left_semi").dropDuplicates(["ord", "tid"])
    full = written(full_sets(text, n), "full")
    links = bucket_links(classes, full, buckets, percent)

    labels = labelled(classes.select("key", "ord"), links)
    labels = written(labels, "labels")
    least = labels.groupBy("label").agg(F.min("ord").alias("least"))
    named = labels.join(least, "label").select("key", "label", "least")
    least = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("ord"))
    out = sets.drop("bands").join(named, "key", "left")
    return out.select(
        "id", "ord", "tid", "n_shingles", F.col("key").alias("class_key"), F.when(F.col("n_shingles") > 0, F.col("label")).alias("group_key"),
        F.when(least == LAST_ID, F.col("id")).otherwise(least).alias("component_id"), (F.col("ord") == least).alias("kept"),
    )
