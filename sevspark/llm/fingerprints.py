"""Document fingerprints as threshold-scaled sketches, with DataFrame operations only.

The sketch of a text keeps every hash of its word shingles below a fixed share of the hash range, whatever the text's
length. A text with words of which no hash is that low has its least hash alone in its sketch: it lies above the share,
so it is told from the others by its value, and it goes as soon as a merged sketch has a low one. So the sketch of a
union is exactly the union of sketches, and a passage's low hashes are all in the sketch of the book that holds it.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked

#: Shingle hashes in the lowest of SCALE equal shares of the hash range are kept.
SCALE, SHINGLE = 8, 5
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def grams(hashed: Column, n: int) -> Column:
    """Hashes of the ``n``-grams of an array bound by ``let``; of all of it where it is shorter, none of an empty one."""
    last = F.greatest(F.size(hashed) - (n - 1), F.lit(1))
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashed, i, n)))
    return F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(every)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the word ``n``-grams, in order: the hashes of the words are hashed in their order."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda hashed: grams(hashed, n))


def low(one: Column, scale: int = SCALE) -> Column:
    """The hashes below the kept share; a least hash that stands alone is left out."""
    return F.filter(one, lambda h: h <= F.lit(2**64 // scale - 2**63 - 1))


def kept(hashes: Column, scale: int = SCALE) -> Column:
    """The sketch of hashes: the distinct ones below the kept share in order, or the least one where none is."""
    least = F.array_compact(F.array(F.array_min(hashes)))
    return let(F.array_sort(F.array_distinct(low(hashes, scale))), lambda few: F.when(F.size(few) > 0, few).otherwise(least))


def sketch(text: Column, n: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sketch of a text: empty for a text without words, the same for equal texts; null counts as empty."""
    return let(shingle_hashes(text, n), lambda hashes: kept(hashes, scale))


def merged(one: Column, other: Column, scale: int = SCALE) -> Column:
    """Sketch of what two texts hold together: that of the union of their shingles."""
    return let(F.concat(one, other), lambda both: kept(both, scale))


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike.

    Where neither has a low hash the least ones are compared: they are equal with the similarity as probability.
    """
    both = F.size(F.array_intersect(one, other))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0).otherwise(both / F.size(F.array_union(one, other)))


def containment(part: Column, whole: Column, scale: int = SCALE) -> Column:
    """Estimated share of ``part`` that is in ``whole``; an empty part is contained.

    A part without low hashes has its least hash only: it is in the whole (1) if that has the same least one, is not (0)
    if that has a greater one or none; else the sketches cannot tell, and the share is null.
    """
    least, other = F.element_at(part, 1), F.get(whole, F.lit(0))
    single = F.when(least == other, 1.0).when(other.isNull() | (other > least), 0.0)
    seen = let(low(part, scale), lambda few: F.when(F.size(few) > 0, F.size(F.array_intersect(few, whole)) / F.size(few)).otherwise(single))
    return F.when(F.size(part) == 0, 1.0).otherwise(seen)


def as_text(one: Column) -> Column:
    """The sketch as hexadecimal digits, 16 for each hash; an empty sketch is the empty string."""
    return F.array_join(F.transform(one, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(rows: DataFrame, order: str, tie: str, value: str, out: str, made=lambda c: c) -> DataFrame:
    """``rows`` with ``value`` replaced by ``made`` of it, and ``out`` as the same of the next row.

    The next row is that by descending ``order``, after the last the first; rows of equal ``order`` follow each other by
    ``tie``, a 64-bit hash. Rows are dealt once, to ranges of ``order`` taken from its quantiles; an ``order`` that takes
    several quantiles (null ids, for one) is dealt to as many ranges of ``tie``. No window sees the whole table. One row per range
    crosses borders. ``made`` is worked out once a row, and once for each that crosses. One row follows itself; rows equal in
    both stay in one range.
    """
    width = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(width, 256)
    found = rows.agg(F.percentile_approx(order, [i / ranges for i in range(ranges + 1)], 10_000)).first()[0] or [0]
    times = Counter(found)
    # a value that is the cut of several quantiles has a range of its own
    cuts = sorted({*times, *(v + 1 for v in times if times[v] > 1 and v < 2**63 - 1)})

    def place(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        mid = (first + last + 1) // 2
        return F.when(F.col(order) >= cuts[mid], place(mid, last)).otherwise(place(first, mid - 1))

    parts = -(-width // ranges)
    counts = [parts * times[v] if times[v] > 1 else parts for v in cuts]
    begins = [sum(counts[:i]) for i in range(len(cuts))]
    spans = [max(1, b - a) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])]
    at = lambda values, kind=float: F.element_at(F.array(*[F.lit(kind(x)) for x in values]), F.col("__range") + 1)
    share = F.when(at([times[v] > 1 for v in cuts], bool), 0.5 - F.col(tie) / F.lit(2.0**64)).otherwise((F.col(order) - at(cuts)) / at(spans))
    within = F.least(F.greatest(F.floor(share * at(counts)), F.lit(0)), at(counts, int) - 1)
    dealt = rows.withColumn("__range", place(0, len(cuts) - 1)).withColumn("__part", at(begins, int) + within).drop("__range")
    first = dealt.groupBy("__part").agg(F.max(F.struct(F.col(order), F.bitwise_not(F.col(tie)), F.struct(value))).alias("head"))
    down = Window.orderBy(F.col("__part").desc())
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # numbers of the ranges alone
    follows = first.select("__part", F.coalesce(F.lead("__part").over(down), F.first("__part").over(every)).alias("__then"))
    heads = follows.join(first.select(F.col("__part").alias("__then"), F.col("head.col3")[value].alias("__head")), "__then")
    heads = heads.select("__part", made(F.col("__head")).alias("__head"))
    own = Window.partitionBy("__part").orderBy(F.col(order).desc(), F.col(tie))
    # made after the exchange, which carries the plain value only
    dealt = dealt.repartition("__part").withColumn(value, made(F.col(value)))
    joined = dealt.withColumn("__next", F.lead(F.struct(value)).over(own)).join(heads, "__part")
    return joined.withColumn(out, F.coalesce(F.col("__next")[value], F.col("__head"))).drop("__part", "__next", "__head")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ord, tid, text, sketch)`` for every row; null and empty texts have the empty sketch."""
    return ranked(docs, id_col, text_col).withColumn("sketch", sketch(F.col("text")))
