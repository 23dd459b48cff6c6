"""License scan with DataFrame operations only: MinHash bands over overlapping windows retrieve templates.

Templates of like length form a class of ``m`` words at most. A text is read in windows of ``2 m`` words, ``m`` apart, so
every passage of up to ``m + 1`` words lies whole in one of them. A window that holds a template has a similarity of about
one third at least, so of ``BANDS`` bands of one MinHash each one agrees with a probability over 0.9999. Windows that agree are
verified by the exact share of the template's shingles that they hold.

Where a band agrees, the shingle of a template's minimum stands in the window. Texts that hold none of these few
shingles are let go before any window is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked
from .fingerprints import grams, let

BANDS, SHINGLE, LEAST = 24, 3, 0.8
#: Lengths of templates of one class differ by this factor at most.
STEP = 1.3
#: Templates and shingles that are held on the driver at most; a larger collection must be scanned in parts.
TEMPLATES, SHINGLES = 10_000, 1_000_000

#: Notices that name a license, as (template, text).
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
]


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words: runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(text: Column, n: int) -> Column:
    return let(word_hashes(text), lambda hashed: grams(hashed, n))


def minima(hashes: Column, bands: int) -> Column:
    """The MinHash of each band of an array of hashes."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[least(b) for b in range(bands)])


def license_scan(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, least: float = LEAST, bands: int = BANDS
) -> DataFrame:
    """``(id, ord, tid, template, containment, first_word, windows)``: a row per text and template found in it.

    ``templates`` is ``(template, text)``, bounded by ``TEMPLATES`` and ``SHINGLES``; templates without words are never found, equal
    ones are all found. ``containment`` is the greatest share of the template's distinct ``n``-word shingles in one window,
    ``least`` at least; ``first_word`` is where the first such window starts. Null and empty texts hold nothing, long ones are
    read whole, repeated rows give repeated results by id and text once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    known = templates.select(F.col("template").cast("string"), F.size(word_hashes(F.col("text"))).alias("words"), shingles(F.col("text"), n).alias("own"))
    known = known.where("words > 0").withColumn("own", F.array_distinct("own"))
    known = known.withColumn("m", F.ceil(F.pow(F.lit(STEP), F.ceil(F.log("words") / F.log(F.lit(STEP)) - 1e-9))).cast("int"))
    known = known.withColumn("m", F.greatest("m", F.lit(n)))
    # the collection of templates has a stated bound
    found = known.select("template", "m", "own").limit(TEMPLATES + 1).collect()
    if len(found) > TEMPLATES or sum(len(r["own"]) for r in found) > SHINGLES:
        raise ValueError("too many templates: scan in parts")
    known = spark.createDataFrame(found, "template string, m int, own array<long>")
    banded = known.select("*", F.posexplode(minima(F.col("own"), bands)).alias("band", "least"))
    # the shingle behind each minimum
    own = [r for r in banded.select("least", "band", "own").select(
        F.filter("own", lambda h: F.xxhash64(h, F.col("band")) == F.col("least"))[0].alias("seed")
    ).distinct().collect()]
    seeds = [r["seed"] for r in own]
    sizes = sorted({r["m"] for r in found})
    if not seeds:
        return ranked(docs, id_col, text_col).select(
            "id", "ord", "tid", F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("windows")
        ).where("false")

    rows = ranked(docs, id_col, text_col).withColumn("own", shingles(F.col("text"), n)).drop("text")
    rows = rows.where(F.exists("own", lambda h: h.isin(seeds)))
    many = F.explode(F.array(*[F.lit(m) for m in sizes])).alias("m")
    rows = rows.select("id", "ord", "tid", "own", many)
    step = F.explode(F.sequence(F.lit(0), F.floor((F.size("own") - 1) / F.col("m")).cast("int"))).alias("window")
    windows = rows.select("id", "ord", "tid", "m", "own", step)
    windows = windows.select(
        "id", "ord", "tid", "m", (F.col("window") * F.col("m")).alias("first_word"),
        F.array_distinct(F.slice("own", F.col("window") * F.col("m") + 1, 2 * F.col("m") - n + 1)).alias("held"),
    ).where(F.exists("held", lambda h: h.isin(seeds)))
    windows = windows.select("*", F.posexplode(minima(F.col("held"), bands)).alias("band", "least"))
    pairs = windows.join(F.broadcast(banded), ["m", "band", "least"])
    share = F.size(F.array_intersect("held", "own")) / F.size("own")
    pairs = pairs.select("id", "ord", "tid", "template", "first_word", share.alias("containment")).where(F.col("containment") >= least)
    found = pairs.groupBy("ord", "tid", "template").agg(
        F.max("id").alias("id"), F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.countDistinct("first_word").alias("windows"),
    )
    return found.select("id", "ord", "tid", "template", "containment", "first_word", "windows")
