"""Best-fit packing planned on a histogram of lengths.

The plan is made over counts: at most ``capacity`` different lengths, longest first; all pieces of one length go at once
into the sequences whose gap fits best, else into new ones. Its size depends on the capacity alone, never on the
number of documents. Pieces then take planned places by their rank within their length.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from ..session import written
from .common import Words, batch_of, ranked, slices, span_hashes

#: Distinct words whose ids one worker remembers at most; beyond it the memory starts anew.
REMEMBERED = 450_000
#: Words asked of the tokenizer at once: its answers take far more memory than the ids.
ASKED = 8_000
#: Bytes of text that are turned into ids at once.
PART_BYTES = 1 << 20
#: Letters before this one are the same in every version of the letter tables.
LATIN = "\u0250"

MARKS, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
MARKS[[44, 46]] = True
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

#: Rows that share a rank bucket of one length, about.
BUCKET_ROWS = 50_000


class WordIds:
    """Token ids of words, asked of the tokenizer once per distinct word and worker, as far as memory is allowed."""

    def __init__(self, path: str):
        # a task has one core; threads of the tokenizer's own would only hold memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.bare, self.known = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        # words of letters alone, lower-cased, need no more than this of the tokenizer's own steps
        self.bare.normalizer = None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def lettered(self, words: list[str]) -> list[bytes] | None:
        """Ids of many words at a time: each ends at the first id that closes a word."""
        parts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        flat = np.array([k for e in self.bare.encode_batch_fast(parts, add_special_tokens=False) for k in e.ids], "<u4")
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(words):
            return None
        return [flat[a:z].tobytes() for a, z in zip(np.concatenate(([0], ends[:-1])), ends)]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        for i in range(0, len(new), ASKED):
            self.ask(new[i : i + ASKED])
        return [self.known[w] for w in words]

    def ask(self, new: list[bytes]) -> None:
        plain, other = {}, []
        for w in new:
            t = w.decode("utf-8", "surrogatepass").lower()
            if t.isalpha() and max(t) < LATIN:
                plain[w] = t
            else:
                other.append(w)
        found = self.lettered(list(plain.values())) if plain else []
        if found is None:
            other, found = new, []
        self.known.update(zip(plain, found))
        if other:
            said = self.whole.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in other], add_special_tokens=False)
            self.known.update(zip(other, (np.array(e.ids, "<u4").tobytes() for e in said)))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def chunks(texts: list[str | None]) -> Words:
    """The words of the texts, full stops and commas at their end apart, A-Z lower-cased as the tokenizer will.

    Between an ASCII letter or digit and a full stop or comma the tokenizer always cuts. Case is kept where special tokens may stand.
    """
    words = Words(texts, lower=not any(t and "<|" in t for t in texts))
    tail, stop = np.zeros(len(words.stop), np.int64), words.stop
    live = np.arange(len(stop))
    while len(live):
        at = stop[live] - tail[live] - 1
        live = live[(at >= words.start[live]) & MARKS[words.bytes[at]]]
        tail[live] += 1
    cut = (tail > 0) & (tail < stop - words.start) & PLAIN[words.bytes[stop - tail - 1]]
    where = np.flatnonzero(cut)
    middle = stop[where] - tail[where]
    words.start = np.insert(words.start, where + 1, middle)
    words.stop = np.insert(stop, where, middle)
    words.at = words.at + np.concatenate(([0], np.cumsum(cut)))[words.at]
    words.hash = span_hashes(words.bytes, words.start, words.stop)
    return words


def ids_of(texts: list[str | None], ids: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end``, and their bounds.

    The tokenizer drops white space and never joins what stands around it, so a text has the ids of its words in a row.
    """
    words = chunks(texts)
    code, names = pd.factorize(words.hash)
    first = np.zeros(len(names), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    known = [*ids([words.word(i) for i in first]), np.array([end], "<u4").tobytes()]
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    begin = np.cumsum(size) - size
    # the end stands after the last word of each text
    code = np.insert(code, words.at[1:], len(names))
    count = size[code]
    total = np.cumsum(count)
    place = np.arange(total[-1] if len(total) else 0) + np.repeat(begin[code] - (total - count), count)
    flat = np.frombuffer(b"".join(known), "<u4")[place]
    stop = words.at[1:] + np.arange(1, len(words.at))
    return flat, np.concatenate(([0], total[stop - 1]))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """``(id, ord, tid, piece, start, length, ids)``: each text's ids and the end, cut at ``capacity``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit values. Null and empty texts are the end alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        for b in slices(batches, "text", PART_BYTES):
            flat, bounds = ids_of(b.column("text").to_pylist(), ids, end)
            count = -(-np.diff(bounds) // capacity)
            own = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(bounds)[own] - start)
            data = pa.py_buffer(flat.astype("<u4").tobytes())
            cuts = np.append(bounds[own] + start, len(flat)) * 4
            blobs = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), data])
            row = pa.array(own)
            yield batch_of(
                id=b.column("id").take(row), ord=b.column("ord").take(row), tid=b.column("tid").take(row), piece=pa.array(piece.astype(np.int32)),
                start=pa.array(start.astype(np.int64)), length=pa.array(length.astype(np.int64)), ids=blobs,
            )
        # the worker outlives the task and may wait beside others
        ids.known = {}

    return ranked(docs, id_col, text_col).mapInArrow(
        run, "id long, ord long, tid long, piece int, start long, length long, ids binary"
    )


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts`` pieces by length: ``(length, low, high, per_sequence, sequence, offset)``.

    The pieces of rank ``low <= r < high`` within their length go ``per_sequence`` to a sequence, from number
    ``sequence`` on, side by side from ``offset``. Best fit, longest first: the smallest sufficient gap is filled
    with as many equal pieces as it holds. Each step uses up a length or a group of equal sequences.
    """
    gaps: list[int] = []  # sorted; groups[g] = runs of sequences with g tokens free
    groups: dict[int, list[tuple[int, int]]] = {}
    places, fresh = [], 0

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                sequence, n = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            else:
                gap = capacity
                sequence, n = fresh, -(-left // (capacity // length))
                fresh += n
            per = min(gap // length, left)
            used = min(n, left // per)
            places.append((length, rank, rank + used * per, per, sequence, capacity - gap))
            leave(gap - per * length, sequence, used)
            leave(gap, sequence + used, n - used)
            rank, left = rank + used * per, left - used * per
    return places


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; they need ``ord``, ``tid``, ``piece``, ``length``, other columns stay.

    ``pieces`` is written once, as its lengths are counted before its rows are placed. Only the histogram (``capacity``
    rows at most) reaches the driver, only the plan is broadcast. Ranks come from buckets of a length, so a length
    that most rows share is dealt to many tasks. No rows: no rows.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "length long, low long, high long, per long, sequence long, shift long"
    places = spark.createDataFrame(plan(counts, capacity), schema)
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS)) * 8
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("ord", "tid", "piece"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "sizes")
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("ord", "tid", "piece")) - 1
    rows = rows.withColumn("inner", inner).join(sizes, ["length", "bucket"])
    rows = rows.withColumn("rank", F.col("inner") + F.col("before"))
    # the plan's size has a bound that only the capacity sets
    p = F.broadcast(places).alias("p")
    r = rows.alias("r")
    hit = (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.low")) & (F.col("r.rank") < F.col("p.high"))
    step = F.col("r.rank") - F.col("p.low")
    return r.join(p, hit).select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("p.sequence") + F.floor(step / F.col("p.per")).cast("long")).alias("sequence_id"),
        (F.col("p.shift") + F.pmod(step, F.col("p.per")) * F.col("r.length")).alias("offset"),
    )


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Packed pieces with their ids: ``token_pieces`` and their places.

    Repeated rows are packed as often as they occur, ties by id and text take any of their ranks. An empty table gives
    no rows.
    """
    return place(token_pieces(docs, id_col, text_col, tokenizer, capacity, end), capacity)
