"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled by a hash; every pass over them follows the one before. A document's virtual
finish time is the number of words its source has given by then, over the source's target. All documents of all
sources are taken in order of finish time until the budget is used up, so at any point each source has given
about its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Buckets of a source's shuffled order, and of finish time, at least, and rows of one on average at most: running sums
#: never need a source in one task.
BUCKETS, BUCKET_ROWS = 1024, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, passes: int) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``: a row per source, nulls last by code point.

    The budget is ``share`` of all sizes, dealt by weight (``weights`` repeat along the order of names); no target
    exceeds ``passes`` times its source, and what is cut off goes to the others by weight until none is above. In order
    of ``passes * size / weight`` the sources that stop are a first part of the list, so running sums find them.
    """
    # one row per source: a window over them needs no key
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int")))
    rows = rows.withColumn("most", passes * F.col("source_size").cast("double"))
    level = F.col("most") / F.col("weight")
    rows = rows.withColumn("level", level)
    order = Window.orderBy("level", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(every)
    rows = rows.withColumn("rest", budget - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("water", F.col("rest") / F.col("weights"))
    # the first source that stays below its most sets the level for all after it
    open_level = F.min(F.when(F.col("water") < F.col("level"), F.struct("level", "water"))).over(every)["water"]
    target = F.least("most", F.coalesce(open_level * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", target.alias("target"))


def running(
    rows: DataFrame, by: list[str], bucket: str, order: list[Column], value: str, out: str, below: float | None = None
) -> DataFrame:
    """``rows`` with ``out``: sum of ``value`` up to and with each row, in order of ``bucket`` and ``order`` within ``by``.

    Buckets are summed first, so a task holds one bucket, and one number per bucket. Values are positive where ``below`` is given:
    then buckets that start at it or above, of which no row ends at it or below, are left out before they are sorted.
    """
    sums = rows.groupBy(*by, bucket).agg(F.sum(value).alias("__sum"))
    # without `by` this window sees the buckets alone: one row for about BUCKET_ROWS of the table
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    if below is not None:
        sums = sums.where(F.col("__before") < below)
    sums = written(sums, "sums")
    match = F.lit(True)
    left, right = rows.alias("l"), sums.alias("r")
    for c in [*by, bucket]:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    inner = F.sum(value).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = left.join(right, match).select("l.*", "r.__before")
    return joined.withColumn(out, F.col("__before") + inner).drop("__before")


def deal(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with whole ``repeats``: the ``count`` of their group, dealt out over its ``twins`` rows as evenly as can be.

    ``groups`` has a row for each group ``by``; rows of others go. Few groups are uneven: the order of the mix leaves the rows of one
    together, so a source is cut inside one of them a pass.
    """

    def joined(part: DataFrame) -> DataFrame:
        match = F.lit(True)
        for c in by:
            match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        return rows.alias("l").join(part.alias("r"), match).select("l.*", "r.count", "r.twins")

    even = joined(groups.where("count % twins = 0")).withColumn("repeats", F.expr("count div twins"))
    uneven = groups.where("count % twins > 0")
    if uneven.limit(1).count() == 0:
        return even.drop("count", "twins")
    odd = written(joined(uneven).withColumn("__place", F.monotonically_increasing_id()).withColumn("__one", F.lit(1)), "uneven")
    odd = odd.withColumn("__part", F.shiftright("__place", 33))
    odd = running(odd, by, "__part", [F.col("__place")], "__one", "__nth")
    odd = odd.withColumn("repeats", F.expr("count div twins + if(__nth <= count % twins, 1, 0)"))
    return even.unionByName(odd.select(even.columns)).drop("count", "twins")


def mix_sources(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=(5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 0
) -> DataFrame:
    """``(id, tid, size, source, source_size, target, repeats, taken)`` for every row of ``docs``.

    ``repeats`` is how often the mix takes the whole document, ``passes`` at most, and ``taken`` its words by that. Null
    sources are one source, the last; null texts have no words and are never taken. Ties of the shuffle are broken by
    id and text; of rows equal in both and in source any are taken. Reruns agree: the order hangs on ids, texts and seed
    only. No rows, or no words: nothing is taken, and targets are 0.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("tid"),
        F.col(source_col).cast("string").alias("source"),
        words_in(F.col(text_col)).alias("size"),
    )
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"), F.col("tid")))
    rows = written(rows, "sizes")
    buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.floor((F.shiftright("draw", 1) / 2.0**62 + 1) / 2 * buckets).cast("long"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(targets(sizes, list(weights), share, passes), "targets")
    # one number
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    order = [F.col("draw"), F.col("id"), F.col("tid")]
    queue = running(rows.where("size > 0"), ["source"], "bucket", order, "size", "given")
    queue = queue.alias("q").join(goal.alias("g"), F.col("q.source").eqNullSafe(F.col("g.source"))).select("q.*", "source_size", "target")
    again = F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))
    queue = queue.select("*", again.alias("pass")).where(F.col("target") > 0)
    finish = (F.col("given") + F.col("pass") * F.col("source_size")) / F.col("target")
    queue = queue.withColumn("finish", finish)
    # the last bucket holds all that comes late; the budget is used up before it, unless texts are longer than targets
    queue = queue.withColumn("slot", F.least(F.floor(F.col("finish") * buckets), F.lit(2 * buckets)).cast("long"))
    queue = written(queue.select("id", "tid", "source", "draw", "size", "finish", "slot", "pass"), "queue")
    order = [F.col("finish"), F.col("source"), F.col("pass"), *order]
    taken = running(queue, [], "slot", order, "size", "total", budget).where(F.col("total") <= budget)
    by = ["id", "tid", "source"]
    counts = taken.select(*by, F.lit(1).alias("got"), F.lit(0).alias("row"))
    counts = counts.union(rows.select(*by, F.lit(0), F.lit(1))).groupBy(*by).agg(F.sum("got").alias("count"), F.sum("row").alias("twins"))
    dealt = deal(rows.select(*by, "size"), written(counts, "taken"), by)
    r, g = dealt.alias("r"), goal.alias("g")
    out = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source")))
    return out.select(
        "r.id", "r.tid", "r.size", "r.source", "g.source_size", "g.target", "r.repeats", (F.col("r.repeats") * F.col("r.size")).alias("taken")
    )
