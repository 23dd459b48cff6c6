"""Exact top-k search in binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits and indexed by each. A round looks up, for every open query, the values at one
more bit from each of its segments. After radius ``s`` in all ``m`` segments every code within ``m (s + 1) - 1`` bits has been met,
since a code farther than ``s`` in each segment is at least ``m (s + 1)`` away. A query closes when its kth verified distance is
covered by that, so results are exact, ties included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

SEGMENT = 16


def sign_code(vector: Column, width: int) -> Column:
    """Segments of the sign bits of a vector of ``width`` numbers: bit 1 where the number is above 0, not where it is null."""

    def segment(k: int) -> Column:
        bits = [
            F.when(F.coalesce(F.get(vector, F.lit(i)) > 0, F.lit(False)), F.lit(1 << (i - k))).otherwise(0)
            for i in range(k, min(k + SEGMENT, width))
        ]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        return total.cast("int")

    return F.array(*[segment(k) for k in range(0, width, SEGMENT)])


def masks(radius: int) -> list[int]:
    """All 16-bit values of exactly ``radius`` bits."""
    return [x for x in range(1 << SEGMENT) if x.bit_count() == radius]


def distance(one: str, other: str) -> Column:
    return F.aggregate(F.zip_with(one, other, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int, segments: int, keys: Sequence[str] = ("id", "code")) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` rows of least Hamming distance to each query, ties by smaller id.

    ``rows`` and ``queries`` have ``(id, code)``, codes of ``segments`` segments; repeated rows count once, an id of several codes by the
    nearest; a query never finds the rows of its own id; null ids and codes are left out. Fewer rows than ``k``: all of them. Of the ids of one code only the ``k + 1``
    smallest can appear in a result, so no more enter the index: a code that many rows share stays small.
    """
    spark = rows.sparkSession
    ids, code = keys
    ranked = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    rows = rows.select(F.col(ids).alias("id"), F.col(code).alias("code")).where("id is not null and code is not null").distinct()
    rows = written(rows.withColumn("n", ranked).where(F.col("n") <= k + 1).drop("n"), "codes")
    index = written(rows.select("*", F.posexplode("code").alias("segment", "value")), "index")
    open_ = queries.select(F.col(ids).alias("query_id"), F.col(code).alias("query")).where("query_id is not null and query is not null")
    open_ = written(open_.distinct(), "queries")
    empty = spark.createDataFrame([], "query_id long, id long, distance int")
    best, done = empty, []
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    for radius in range(SEGMENT + 1):
        # a value's masks are a fixed list, at most 12 870 numbers long
        flips = F.explode(F.array(*[F.lit(x) for x in masks(radius)])) if radius <= 1 else F.explode(F.expr(
            f"filter(sequence(0, {(1 << SEGMENT) - 1}), x -> bit_count(x) = {radius})"
        ))
        probes = open_.select("*", F.posexplode("query").alias("segment", "own")).select("*", flips.alias("flip"))
        probes = probes.select("query_id", "query", "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
        # probes are many times the queries they come from: they must not be taken for a small table and broadcast
        met = probes.join(index.hint("merge"), ["segment", "value"]).where("id != query_id")
        met = met.select("query_id", "id", distance("query", "code").alias("distance")).distinct()
        # a row that another segment met before is the same row again
        met = met.union(best).groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        best = written(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        reach = F.lit(segments * (radius + 1) - 1)
        closed = best.where((F.col("rank") == k) & (F.col("distance") <= reach)).select("query_id")
        if radius == SEGMENT:
            done.append(best)
            break
        closed = written(closed, "closed")
        done.append(best.join(closed, "query_id", "left_semi"))
        best = best.join(closed, "query_id", "left_anti").select("query_id", "id", "distance")
        open_ = written(open_.join(closed, "query_id", "left_anti"), "queries")
        if not open_.limit(1).count():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("query_id", "rank", "id", "distance")
