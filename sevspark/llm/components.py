"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links ``(a, b)`` with ``a > b``.

    The large step points every greater neighbour of a node to its least neighbour; the small step points
    a node and its lesser neighbours to the least of them.
    """
    ends = links.union(links.select("b", "a")) if large else links
    ends = ends.toDF("u", "v")
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if large:
        out = ends.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = ends.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of the links ``(a, b)``, label = least node it reaches; nulls are ignored.

    Stars alternate until every node but the least of its component hangs on that one; the number of rounds
    is about the logarithm of the longest chain. Only counts reach the driver. No links: no rows.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    links = written(links, "links")
    while True:
        nxt = written(_star(_star(links, True), False), "links")
        # finished when no node hangs on two nodes and no node that hangs is hung on
        state = nxt.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        hung = state.where("n > 1").limit(1).count()
        if not hung and not nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        links = nxt
    own = nxt.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("label")).union(own)
