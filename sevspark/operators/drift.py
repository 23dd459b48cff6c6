"""Feature drift between a reference and a current side.

All features travel together as ``(feature, value)`` rows and collapse to counts per side before any
ordering, so the cost after the first aggregation follows the number of distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from .aggregate import melt
from .ordered import Ordered


def side_counts(df: DataFrame, features: Sequence[str], is_current: Column, dtype: str = "double") -> DataFrame:
    """``(feature, value, ref, cur)`` row counts; NULL values are left out."""
    rows = melt(df.withColumn("_cur", is_current), features, ["_cur"], dtype).dropna(subset=["value"])
    return rows.groupBy("feature", "value").agg(
        F.count_if(~F.col("_cur")).alias("ref"), F.count_if("_cur").alias("cur")
    )


def _totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))


def distances(counts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Wasserstein (plain and divided by the reference's deviation) and KS per feature."""
    keys = list(keys)
    line = Ordered(counts, keys, ["value"], unique=True)
    counts = line.rows()  # materialised once; the moments below read it again
    steps = line.previous({"_before": "value"}).running_sum({"_cr": "ref", "_cc": "cur"}).rows()
    moments = counts.groupBy(*keys).agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
        F.try_divide(F.sum(F.col("ref") * F.col("value")), F.sum("ref")).alias("_mean"),
    )
    spread = counts.join(moments.select(*keys, "_mean"), keys).groupBy(*keys).agg(
        F.sqrt(
            F.try_divide(F.sum(F.col("ref") * F.pow(F.col("value") - F.col("_mean"), 2)), F.sum("ref"))
        ).alias("std_ref")
    )
    # distribution functions after this value, and over the gap before it
    after = F.abs(F.col("_cr") / F.col("n_ref") - F.col("_cc") / F.col("n_cur"))
    gap = F.abs(
        (F.col("_cr") - F.col("ref")) / F.col("n_ref") - (F.col("_cc") - F.col("cur")) / F.col("n_cur")
    ) * (F.col("value") - F.col("_before"))
    both_sides = moments.filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0)).drop("_mean")
    found = steps.join(both_sides, keys).groupBy(*keys, "n_ref", "n_cur").agg(
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("wasserstein"), F.max(after).alias("ks")
    )
    norm = F.greatest(F.col("std_ref"), F.lit(0.001))
    return found.join(spread, keys).withColumn("wasserstein_normed", F.col("wasserstein") / norm)


def divergences(counts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Chi-square (reference scaled to the current size), its degrees, and Jensen-Shannon distance."""
    keys = list(keys)
    both = counts.join(_totals(counts, keys), keys).filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
    p, q = F.col("ref") / F.col("n_ref"), F.col("cur") / F.col("n_cur")
    m = (p + q) / 2
    expected = p * F.col("n_cur")
    chi = F.when(expected > 0, F.pow(F.col("cur") - expected, 2) / expected).otherwise(F.lit(0.0))

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    return both.groupBy(*keys, "n_ref", "n_cur").agg(
        F.sum(chi).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("dof"),
        F.count_if((F.col("ref") == 0) & (F.col("cur") > 0)).alias("unseen"),
        F.sqrt(F.greatest((F.sum(part(p)) + F.sum(part(q))) / 2, F.lit(0.0))).alias("js"),
    )


def ks_p_value(statistic: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    lam = statistic * F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(2 * series, F.lit(1.0)), F.lit(0.0)))


_LANCZOS = [76.18009172947146, -86.50532032941677, 24.01409824083091,
            -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5]


def _ln_gamma(a: Column) -> Column:
    series: Column = F.lit(1.000000000190015)
    for i, c in enumerate(_LANCZOS, start=1):
        series = series + F.lit(c) / (a + i)
    tmp = a + 5.5
    return (a + 0.5) * F.ln(tmp) - tmp + F.ln(F.lit(math.sqrt(2 * math.pi)) * series / a)


def chi2_p_value(chi2: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, for the few rows of a drift report.

    The incomplete gamma function: below the mean by its power series, above it by its continued fraction. Both need
    a number of terms that grows with the root of the degrees of freedom, and get it.
    """
    a, x = dof / 2.0, chi2 / 2.0
    steps = F.sequence(F.lit(1), F.ceil(60 + 12 * F.sqrt(F.greatest(a, F.lit(1.0)))).cast("int"))
    scale = F.exp(-x + a * F.ln(x) - _ln_gamma(a))

    walked = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, k: F.struct(
            (s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total")
        ),
    )
    lower = walked["total"] * scale / a

    first = x + 1 - a
    start = F.struct(F.lit(1e300).alias("c"), F.try_divide(F.lit(1.0), first).alias("d"), F.try_divide(F.lit(1.0), first).alias("value"))

    def step(s: Column, k: Column) -> Column:
        top, bottom = -k * (k - a), first + 2 * k
        c, d = bottom + F.try_divide(top, s["c"]), F.try_divide(F.lit(1.0), top * s["d"] + bottom)
        return F.struct(c.alias("c"), d.alias("d"), (s["value"] * c * d).alias("value"))

    upper = F.aggregate(steps, start, step)["value"] * scale
    tail = F.when(x < a + 1, 1 - lower).otherwise(upper)
    return F.when((dof <= 0) | (chi2 <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def column_flags(
    numeric: DataFrame, categorical: DataFrame, keys: Sequence[str] = ("feature",),
    test: str = "by_size", large: int = 1000, distance: float = 0.1, p_limit: float = 0.05,
) -> DataFrame:
    """Per feature: test used, score (4 decimals), drifted or not.

    ``by_size`` takes distances (normed Wasserstein, Jensen-Shannon) above ``large`` reference rows and
    p-values (KS, chi-square) up to it; 'distance' and 'p_value' force one of them.
    """
    by_distance = {"by_size": F.col("n_ref") > large, "distance": F.lit(True), "p_value": F.lit(False)}[test]

    def pick(df: DataFrame, far: str, far_name: str, p: Column, p_name: str) -> DataFrame:
        score = F.when(by_distance, F.col(far)).otherwise(p)
        return df.select(
            *keys, "n_ref", "n_cur",
            F.when(by_distance, F.lit(far_name)).otherwise(F.lit(p_name)).alias("test"),
            F.round(score, 4).alias("score"),
            F.when(by_distance, score >= distance).otherwise(score < p_limit).alias("drifted"),
        )

    num = pick(
        numeric, "wasserstein_normed", "wasserstein", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")), "ks"
    )
    # a category the reference never showed has no finite expectation: certain drift
    chi_p = F.when(F.col("unseen") > 0, F.lit(0.0)).otherwise(chi2_p_value(F.col("chi2"), F.col("dof")))
    return num.unionByName(pick(categorical, "js", "jensenshannon", chi_p, "chisquare"))


def dataset_drift(flags: DataFrame, keys: Sequence[str] = (), share_limit: float = 0.5) -> DataFrame:
    """Drifted count, total, share and the dataset flag."""
    return flags.groupBy(*keys).agg(
        F.count_if("drifted").alias("drifted_count"),
        F.count(F.lit(1)).alias("total_features"),
        F.avg(F.col("drifted").cast("double")).alias("drift_share"),
    ).withColumn("drift_detected", F.col("drift_share") >= share_limit)


def level_of(share: Column, limits: tuple[float, float] = presets.DRIFT_LEVELS) -> Column:
    warning, critical = limits
    return F.when(share > critical, F.lit("CRITICAL")).when(share > warning, F.lit("WARNING")).otherwise(F.lit("OK"))


def level_code(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in presets.ALERT_LEVELS.items():
        out = F.when(level == name, F.lit(code)).otherwise(out)
    return out


def summary(flags: DataFrame, keys: Sequence[str] = (), share_limit: float = 0.5) -> DataFrame:
    """One row per key: level, counts, score map and list of drifted features.

    The map holds one entry per feature, an argument-sized list.
    """
    share = F.avg(F.col("drifted").cast("double"))
    return flags.groupBy(*keys).agg(
        F.count_if("drifted").alias("drifted_count"),
        F.count(F.lit(1)).alias("total_features"),
        F.round(share, 3).alias("drift_share"),
        (share >= share_limit).alias("drift_detected"),
        F.max("n_cur").alias("rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "score")))).alias("feature_scores"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
    ).withColumn("level", level_of(F.col("drift_share")))


def first_year_summary(year: int) -> dict:
    """What a year without earlier years reports."""
    return {"year": year, "rows": 0, "drift_detected": False, "drifted_features": []}


def by_year(df: DataFrame, features: Sequence[str], year: str, dtype: str = "double") -> DataFrame:
    """``(year, feature, value, ref, cur)`` for every year against all earlier ones.

    Counts per (feature, value, year) are taken once; each is then offered to the years it serves.
    The first year has no reference and is left out. Years are few by nature of the data model.
    """
    rows = melt(df, features, [year], dtype).dropna(subset=["value", year])
    counts = rows.groupBy(year, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    bounds = df.agg(F.struct(F.min(year).alias("lo"), F.max(year).alias("hi"))).scalar()
    served = counts.withColumn("_for", F.explode(F.sequence(F.greatest(F.col(year), bounds["lo"] + 1), bounds["hi"])))
    own = F.col("_for") == F.col(year)
    out = served.groupBy(F.col("_for").alias(year), "feature", "value").agg(
        F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("ref"),
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("cur"),
    )
    return out


def gauges(summaries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys..., name, feature, value)`` for level, share, counts and every feature score."""
    def one(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit("").alias("feature"), value.cast("double").alias("value"))

    scores = F.transform(
        F.map_entries("feature_scores"),
        lambda e: F.struct(
            F.lit("drift_feature_score").alias("name"), e["key"].alias("feature"), e["value"].alias("value")
        ),
    )
    fixed = F.array(
        one("drift_level", level_code(F.col("level"))), one("drift_share", F.col("drift_share")),
        one("drift_drifted_count", F.col("drifted_count")), one("drift_total_features", F.col("total_features")),
    )
    return summaries.select(*keys, F.inline(F.concat(fixed, scores)))


def alerts(summaries: DataFrame, year: str) -> DataFrame:
    """One event line per WARNING or CRITICAL summary."""
    line = F.format_string(
        "event=alert severity=%s topic=drift year=%d share=%.3f drifted=%d", F.lower("level"),
        F.col(year), F.col("drift_share"), F.col("drifted_count"),
    )
    return summaries.filter(F.col("level") != "OK").select(year, "level", line.alias("line"))
