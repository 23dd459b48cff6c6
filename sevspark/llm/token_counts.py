"""Token counts without ids: pieces are counted once per distinct pre-token, then joined to pre-token frequencies.

A pre-token is a run of spaces with what follows it, or a line feed with what follows it, up to the next of either. No
piece of the vocabulary crosses such a border (checked when the model is read), so a text has the pieces of its
pre-tokens in a row. Pre-tokens that make up more than ``1 / HOT`` of all text are hot: there are fewer than ``HOT``
of them, their counts go to all tasks and never enter the join; the others are shuffled by pre-token.

What is shuffled. A slice of texts sends one row per bucket of pre-tokens: each pre-token once, with the numbers of its
texts in the slice. Back comes a row per bucket with sums by text, and meets the slice's ids and sizes there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import batch_of, ranked, signed, slices, span_hashes

HOT = 1 << 19
SPACE, FEED = 32, 10
#: Buckets of pre-tokens for each task that counts them: the tokens of one bucket are held at once.
BUCKETS = 4
HEAD, PART = 0, 1


@cache
def processor(path: str):
    """The sentencepiece model; fails if a piece could cross a pre-token border."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece or " " in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
    return model


def pieces_of(path: str, tokens: list[str]) -> np.ndarray:
    """Number of pieces of each pre-token. The model itself puts a space before what it is given."""
    model = processor(path)
    said = model.encode([t[1:] if t[:1] == " " else t for t in tokens], num_threads=1)
    # after a line feed no space stands, so the model's own is not counted; a lone space is one piece
    return np.array([1 if t == " " else len(s) - (t[:1] == "\n") for t, s in zip(tokens, said)], np.int64)


class PreTokens:
    """Distinct pre-tokens of several texts: ``code`` by occurrence, ``text`` of each occurrence, ``hash`` by code."""

    def __init__(self, texts: list[str | None]):
        parts = [b" " + t.replace("▁", " ").encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.bytes = np.frombuffer(b"".join(parts) + b" " * 16, np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        whole = self.bytes[: ends[-1]] if len(ends) else self.bytes[:0]
        space = whole == SPACE
        border = space | (whole == FEED)
        border[1:] &= ~(space[1:] & space[:-1])
        filled = np.array([len(p) > 0 for p in parts], bool)
        border[(ends - [len(p) for p in parts])[filled]] = True
        start = np.flatnonzero(border)
        stop = np.append(start[1:], len(whole)) if len(start) else start
        self.text = np.searchsorted(ends, start, "right")
        self.code, self.hash = pd.factorize(span_hashes(self.bytes, start, stop))
        first = np.zeros(len(self.hash), np.int64)
        first[self.code[::-1]] = np.arange(len(self.code))[::-1]
        self.start, self.stop = start[first], stop[first]

    def tokens(self, codes: np.ndarray) -> list[bytes]:
        return [self.bytes[a:z].tobytes() for a, z in zip(self.start[codes], self.stop[codes])]


def frequent(rows: DataFrame) -> DataFrame:
    """``(hash, token, n)`` of pre-tokens that may be hot, and the number of all occurrences as null token.

    A task reports what has half the share of a hot one in its own rows. Which pre-tokens are found only decides how
    they travel, never what is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, total = pd.Series(dtype="int64"), {}, 0
        for b in slices(batches, "text"):
            pre = PreTokens(b.column("text").to_pylist())
            n = np.bincount(pre.code, minlength=len(pre.hash))
            total += int(n.sum())
            # what occurs once in a slice is left out: it is not frequent
            often = np.flatnonzero(n > 1)
            seen = seen.add(pd.Series(n[often], signed(pre.hash[often])), fill_value=0).astype("int64")
            fresh = often[~np.isin(signed(pre.hash[often]), np.fromiter(tokens, np.int64, len(tokens)))]
            tokens.update(zip(signed(pre.hash[fresh]).tolist(), pre.tokens(fresh)))
        seen = seen[seen * 2 * HOT > total]
        yield batch_of(
            hash=pa.array([*seen.index, 0], pa.int64()), token=pa.array([*(tokens[k] for k in seen.index), None], pa.binary()),
            n=pa.array([*seen, total], pa.int64()),
        )

    found = rows.select("text").mapInArrow(run, "hash long, token binary, n long")
    return found.groupBy("hash", "token").agg(F.sum("n").alias("n"))


def hot_counts(rows: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the hot pre-tokens in order, and their numbers of pieces: fewer than ``HOT`` of them."""
    found = written(frequent(rows), "frequent")
    total = found.where("token is null").agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("token").isNotNull() & (F.col("n") * HOT > total)).select("hash", "token").toArrow()
    key = hot.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(key)
    tokens = [t.decode() for t in hot.column("token").to_pylist()]
    return key[order], pieces_of(path, tokens)[order] if tokens else np.empty(0, np.int64)


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32, all their low bytes first: mostly small ones compress well that way."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row, as the sentencepiece model at ``model`` would count it.

    Whole texts, without begin, end or padding; null and empty texts have none. Repeated rows come back as often as they
    occur; other columns are dropped. An empty table gives no rows. If a lost task of ``docs`` comes back with its rows
    in another order, its slices no longer fit together and the query fails.
    """
    rows = ranked(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(hot_counts(rows, model))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * width

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice a head (ids, sizes, pieces of hot pre-tokens) and the rare pre-tokens of each bucket."""
        key, pieces = shared.value
        for k, b in enumerate(slices(batches, "text")):
            pre = PreTokens(b.column("text").to_pylist())
            hot, known = np.zeros(len(pre.hash), bool), np.zeros(len(pre.hash), np.int64)
            if len(key):
                at = np.minimum(np.searchsorted(key, pre.hash), len(key) - 1)
                hot = key[at] == pre.hash
                known = np.where(hot, pieces[at], 0)
            sums = np.bincount(pre.text, weights=known[pre.code], minlength=b.num_rows).astype(np.int64)
            rare = ~hot[pre.code]
            kinds = max(1, len(pre.hash))
            pair, n = np.unique(pre.code[rare] * np.int64(b.num_rows) + pre.text[rare], return_counts=True)
            code, text = np.divmod(pair, b.num_rows)
            bucket = (pre.hash % np.uint64(buckets)).astype(np.int64)[code]
            order = np.argsort(bucket * kinds + code, kind="stable")
            code, text, n, bucket = code[order], text[order], n[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))[: len(code)])
            posts, tokens = np.diff(np.append(first, len(code))), pre.tokens(code[first])
            # bounds of each bucket among the pairs and among the tokens
            lead = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(code)])
            pairs = list(zip(lead, np.append(lead[1:], len(code))))
            named = np.searchsorted(first, np.append(lead, len(code)))
            ids, sizes = b.column("id"), pc.fill_null(pc.binary_length(b.column("text")), 0)
            plain = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
            head = np.stack([plain(pc.fill_null(ids, 0)), plain(ids.is_null()), plain(sizes), sums])
            # named by place and rows, so that parts of another order of rows are never taken for these
            place = f"{TaskContext.get().partitionId()} {k} ".encode() + head.tobytes() + b.column("tid").to_numpy().tobytes()
            chunk = int.from_bytes(hashlib.blake2b(place, digest_size=8).digest(), "little", signed=True)
            many = range(1, len(named))
            yield batch_of(
                bucket=pa.array([chunk % buckets, *bucket[lead].tolist()], pa.int32()), chunk=pa.array([chunk] * (1 + len(lead)), pa.int64()),
                kind=pa.array([HEAD] + [PART] * len(lead), pa.int32()), pairs=pa.array([len(code)] + [int(z - a) for a, z in pairs], pa.int64()),
                tokens=pa.array([None] + [b"\xff".join(tokens[named[i - 1] : named[i]]) for i in many], pa.binary()),
                posts=pa.array([None] + [planes(posts[named[i - 1] : named[i]]) for i in many], pa.binary()),
                texts=pa.array([None] + [planes(text[a:z]) for a, z in pairs], pa.binary()),
                n=pa.array([head.tobytes()] + [planes(n[a:z]) for a, z in pairs], pa.binary()),
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequencies times pieces, by text. The rows come in order of bucket, so each pre-token is counted once."""
        last, found = None, {}
        for b in batches:
            texts, n = [], []
            for bucket, kind, joined, posts, held, times in zip(*(b.column(c) for c in ("bucket", "kind", "tokens", "posts", "texts", "n"))):
                if kind.as_py() == HEAD:
                    texts.append(None), n.append(times.as_py())
                    continue
                if bucket.as_py() != last:
                    last, found = bucket.as_py(), {}
                tokens = joined.as_py().split(b"\xff")
                new = [t for t in tokens if t not in found]
                if new:
                    found.update(zip(new, pieces_of(model, [t.decode() for t in new]).tolist()))
                each = np.repeat(np.array([found[t] for t in tokens], np.int64), numbers(posts.as_py()))
                at = numbers(held.as_py())
                used, place = np.unique(at, return_inverse=True)
                sums = np.bincount(place, weights=each * numbers(times.as_py()))
                texts.append(planes(np.diff(used, prepend=0))), n.append(planes(sums))
            yield batch_of(chunk=b.column("chunk"), kind=b.column("kind"), pairs=b.column("pairs"), texts=pa.array(texts, pa.binary()), n=pa.array(n, pa.binary()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each slice's rows: its head comes first, then its buckets."""
        chunk, head, left = None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if left:
                raise RuntimeError("rows of a slice came in another order when its task ran again")
            if head is not None:
                yield batch_of(id=pa.array(head[0], mask=head[1] == 1), n_bytes=pa.array(head[2]), n_tokens=pa.array(head[3]))

        for b in batches:
            for name, kind, pairs, texts, n in zip(*(b.column(c) for c in ("chunk", "kind", "pairs", "texts", "n"))):
                if kind.as_py() == HEAD:
                    yield from done()
                    chunk, left = name.as_py(), pairs.as_py()
                    head = np.frombuffer(n.as_py(), np.int64).reshape(4, -1).copy()
                    continue
                if name.as_py() != chunk:
                    raise RuntimeError("rows of a slice came in another order when its task ran again")
                head[3, np.cumsum(numbers(texts.as_py()))] += numbers(n.as_py())
                left -= pairs.as_py()
        yield from done()

    schema = "bucket int, chunk long, kind int, pairs long, tokens binary, posts binary, texts binary, n binary"
    parts = rows.mapInArrow(spread, schema).repartition(width, "bucket").sortWithinPartitions("bucket")
    parts = parts.mapInArrow(count, "chunk long, kind int, pairs long, texts binary, n binary")
    parts = parts.repartition(width, "chunk").sortWithinPartitions("chunk", "kind")
    return parts.mapInArrow(gather, "id long, n_bytes long, n_tokens long")
