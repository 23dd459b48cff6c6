"""Substring dedup by recompression: words covered by a window that also starts earlier go.

Names. Every word is a symbol. A round names maximal runs of equal symbols, then pairs of neighbours whose left
symbol falls on the left half of the alphabet and whose right symbol on the right half. A name is a 64-bit hash of
what it stands for, so all tasks give equal strings equal names without exchanging them. Each symbol also carries
its context: the words that decided how it was formed. Equal windows hold the same symbols of which the whole
context lies inside them, whatever stands around.

Anchors. Every window picks, among those interior symbols, the one of the highest round with the least name.
Consecutive windows that pick the same symbol form an *instance*: key = content of the symbol's context, bundle =
content of all its windows together. Equal windows have equal keys.

Rounds on Spark. (1) Instances meet by key. One whose bundle is in an earlier document is a repeat as a whole: its
windows need no further look. Where a key has different bundles, the first holder of each is looked at window by
window. (2) Those windows meet by content. (3) Texts meet their repeats and lose the covered words. Windows that
repeat inside one document are found there. Texts are shuffled once: one exchange serves (2) and (3).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .common import RunHash, Words, batch_of, mix, ranked, signed, slices, starts_of

ROUNDS = 2
#: Bytes of text whose symbols are held at once: every word has some thirty numbers of 8 bytes at the peak.
PART_BYTES = 1 << 20
_RUN, _PAIR, _SIDE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_FAR = np.int64(1 << 40)


def neighbours(values: np.ndarray, edge: np.ndarray, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of the symbol to the left and to the right; ``out`` (with sign) beyond a text. ``edge`` starts texts."""
    left, right = np.empty_like(values), np.empty_like(values)
    left[1:], right[:-1] = values[:-1], values[1:]
    left[edge] = -out
    right[edge[1:] - 1] = out
    right[-1:] = out
    return left, right


def one_round(name, first, low, high, text, salt):
    """Runs, then pairs; bounds grow along the text. Returns the symbols of the next round: name, first word, context bounds, text."""
    edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    # where a run begins and ends is known from the symbols beside it
    left, right = neighbours(low, edge, _FAR)[0], neighbours(high, edge, _FAR)[1]
    head = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(head[1:], len(name)) - 1
    length = (last - head + 1).astype(np.uint64)
    run = np.where(length > 1, mix(mix(name[head] ^ _RUN) + length), name[head])
    first, text, low, high = first[head], text[head], left[head], right[last]
    edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))

    side = mix(run ^ (_SIDE + salt)) >> np.uint64(63) == 1  # right half
    pair = np.zeros(len(run), bool)
    pair[:-1] = ~side[:-1] & side[1:] & (text[:-1] == text[1:])
    second = np.concatenate(([False], pair[:-1]))
    alone = ~pair & ~second
    left, right = neighbours(low, edge, _FAR)[0], neighbours(high, edge, _FAR)[1]
    low = np.where(alone & side, left, low)
    high = np.where(alone & ~side, right, high)
    high[:-1] = np.where(pair[:-1], high[1:], high[:-1])
    joined = run.copy()
    joined[:-1] = np.where(pair[:-1], mix(mix(run[:-1] ^ _PAIR) + run[1:]), run[:-1])
    kept = ~second
    return joined[kept], first[kept], low[kept], high[kept], text[kept]


def anchors(words: Words, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window of ``n`` words, the bounds of its anchor's context, and the anchor's number."""
    first, bounds = starts_of(words, n)
    size = len(words.hash)
    if not len(first):
        none = np.empty(0, np.int64)
        return first, none, none, none
    text = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    level = (words.hash, np.arange(size), np.arange(size), np.arange(size) + 1, text)
    ranks, lows, highs = [], [], []
    for r in range(rounds + 1):
        if r:
            level = one_round(*level, np.uint64(r))
        name, _, low, high, _ = level
        ranks.append((np.uint64(rounds - r) << np.uint64(62)) | (mix(name) >> np.uint64(26) << np.uint64(24)))
        lows.append(low), highs.append(high)
    rank, lows, highs = np.concatenate(ranks), np.concatenate(lows), np.concatenate(highs)
    # places in order of rank, then of number: they tell any number of symbols apart
    order = np.argsort(rank, kind="stable")
    del ranks, rank, level, name, text
    best = np.full(size + 1, len(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = np.flatnonzero(highs - lows <= n)
    low, high, place = lows[at], highs[at], place[at]
    for step in range(n):
        start = low - step
        ok = (start >= 0) & (start + n >= high)
        if not ok.any():
            break
        np.minimum.at(best, start[ok], place[ok])
    number = order[best[first]]
    return first, lows[number], highs[number], number


def instances(docs: DataFrame, n: int, rounds: int) -> DataFrame:
    """``(ord, tid, key, bundle, start, windows)``: runs of windows of one document with the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PART_BYTES):
            words = Words(b.column("text").to_pylist())
            first, low, high, number = anchors(words, n, rounds)
            text = np.searchsorted(words.at, first, "right") - 1
            fresh = np.concatenate(([True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])))[: len(first)]
            head = np.flatnonzero(fresh)
            count = np.diff(np.append(head, len(first)))
            runs, start, low = RunHash(words.hash), first[head], low[head]
            key = runs(low, high[head])
            whole = runs(start, start + count + n - 1)
            bundle = mix(whole ^ (low - start).astype(np.uint64))
            # what stands again in the same text is found there: the first of each bundle speaks for all
            order = np.lexsort((np.arange(len(head)), bundle, key, text[head]))
            same = [x[order][1:] == x[order][:-1] for x in (text[head], key, bundle)]
            once = np.sort(order[np.concatenate(([True], ~(same[0] & same[1] & same[2])))[: len(head)]])
            head, start, count, key, bundle = head[once], start[once], count[once], key[once], bundle[once]
            own = pa.array(text[head])
            yield batch_of(
                ord=b.column("ord").take(own), tid=b.column("tid").take(own), key=pa.array(signed(key)), bundle=pa.array(signed(bundle)),
                start=pa.array((start - words.at[text[head]]).astype(np.int32)), windows=pa.array(count.astype(np.int32)),
            )

    return docs.select("ord", "tid", "text").mapInArrow(run, "ord long, tid long, key long, bundle long, start int, windows int")


def windows_of(docs: DataFrame, n: int) -> DataFrame:
    """``(key, content, ord, tid, start)`` of the windows of each ``spans`` entry, the first of each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PART_BYTES):
            words = Words(b.column("text").to_pylist())
            spans = b.column("spans")
            flat, own = spans.flatten(), np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
            key, start, count = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            count = count.astype(np.int64)
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)
            own, key = np.repeat(own, count), np.repeat(key, count)
            place = words.at[own] + at
            content = RunHash(words.hash)(place, place + n)
            order = np.lexsort((at, content, key, own))
            own, key, content, at = own[order], key[order], content[order], at[order]
            same = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            fresh = np.concatenate(([True], ~same))[: len(own)]
            own, row = own[fresh], pa.array(own[fresh])
            yield batch_of(
                key=pa.array(key[fresh]), content=pa.array(signed(content[fresh])), ord=b.column("ord").take(row),
                tid=b.column("tid").take(row), start=pa.array(at[fresh].astype(np.int32)),
            )

    # no column is left out: the exchange of the texts can serve the last join too
    return docs.mapInArrow(run, "key long, content long, ord long, tid long, start int")


def spans_by_row(rows: DataFrame, *columns: str) -> DataFrame:
    """Each span once, however many rows are equal in id and text."""
    return rows.groupBy("ord", "tid").agg(F.collect_set(F.struct(*columns)).alias("spans"))


def repeats(docs: DataFrame, n: int, rounds: int) -> DataFrame:
    """``(ord, tid, start, windows)``: runs of windows that occur in a document of smaller ``ord``."""
    # one exchange by key serves both windows
    by_key, by_bundle = Window.partitionBy("key"), Window.partitionBy("key", "bundle")
    found = instances(docs, n, rounds).select("*", (F.min("bundle").over(by_key) != F.max("bundle").over(by_key)).alias("various"))
    judged = found.withColumn("whole", F.min("ord").over(by_bundle) < F.col("ord")).where("whole or various")
    judged = written(judged.select("ord", "tid", "key", "start", "windows", "whole"), "judged")
    opened = docs.join(spans_by_row(judged.where("not whole"), "key", "start", "windows"), ["ord", "tid"])
    single = windows_of(opened, n).withColumn("first", F.min("ord").over(Window.partitionBy("key", "content")))
    single = single.where("first < ord").select("ord", "tid", "start", F.lit(1).alias("windows"))
    return judged.where("whole").select("ord", "tid", "start", "windows").union(single)


def covered(words: Words, n: int, spans: pa.Array) -> np.ndarray:
    """Whether each word lies in a repeated window: those of ``spans`` and those that stand earlier in its text."""
    hits = np.zeros(len(words.hash) + 1, np.int64)
    first, _ = starts_of(words, n)
    content = RunHash(words.hash)(first, first + n)
    text = np.searchsorted(words.at, first, "right") - 1
    order = np.argsort(mix(content) + text.astype(np.uint64), kind="stable")
    c, t = content[order], text[order]
    again = np.concatenate(([False], (c[1:] == c[:-1]) & (t[1:] == t[:-1])))[: len(first)]
    later = first[order[again]]
    np.add.at(hits, later, 1)
    np.add.at(hits, later + n, -1)
    if spans.null_count < len(spans):
        own = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        start = words.at[own] + flat.field(0).to_numpy(zero_copy_only=False)
        np.add.at(hits, start, 1)
        np.add.at(hits, start + flat.field(1).to_numpy(zero_copy_only=False) + n - 1, -1)
    return np.cumsum(hits)[:-1] > 0


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, rounds: int = ROUNDS, carry: Sequence[str] = ()
) -> DataFrame:
    """``(id, ord, tid, n_words, n_removed, kept_text)`` for every row of ``docs``.

    A window is ``window`` consecutive words (bytes between white space) of one text. Words covered by a window that
    also starts earlier, in a document of smaller id or before it in the same text, are removed; all windows are
    judged on the input. ``kept_text`` has the other words joined by one space, and null stays null. Texts of fewer
    words lose nothing. A null id counts as the greatest. Rows of the same id are judged apart: neither is earlier
    than the other. Windows are compared by 64-bit content within the same 64-bit key. An empty table gives no rows.
    With ``carry``, the text as it was and a struct ``row`` of these columns of ``docs`` follow, so that nobody needs to
    join them again.
    """
    if carry:
        rows = docs.select(id_col, text_col, F.struct(*carry).alias("row"))
        kind = rows.schema["row"].dataType.simpleString()
        more, schema = ["text", "row"], f", text string, row {kind}"
        rows = ranked(rows, id_col, text_col, "row")
    else:
        rows, more, schema = ranked(docs, id_col, text_col), [], ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PART_BYTES):
            texts = b.column("text").to_pylist()
            words = Words(texts)
            gone = covered(words, window, b.column("spans"))
            kept = []
            for i, t in enumerate(texts):
                a, z = words.at[i], words.at[i + 1]
                if t is None or not gone[a:z].any():
                    kept.append(t if t is None else b" ".join(t.encode("utf-8", "surrogatepass").split()))
                else:
                    own = t.encode("utf-8", "surrogatepass").split()
                    kept.append(b" ".join(own[k] for k in np.flatnonzero(~gone[a:z])))
            sums = np.concatenate(([0], np.cumsum(gone)))
            yield batch_of(
                id=b.column("id"), ord=b.column("ord"), tid=b.column("tid"), n_words=pa.array(np.diff(words.at).astype(np.int64)),
                n_removed=pa.array(np.diff(sums[words.at])), kept_text=pa.array(kept, pa.binary()).cast(pa.string()),
                **{c: b.column(c) for c in more},
            )

    marks = spans_by_row(repeats(rows, window, rounds), "start", "windows")
    return rows.join(marks, ["ord", "tid"], "left").mapInArrow(
        run, f"id long, ord long, tid long, n_words long, n_removed long, kept_text string{schema}"
    )
