"""Prefix sums, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, evaluate, ordered, rank
from .base import Tables, query
from .raw import STEPS

# ---- ordered --------------------------------------------------------------------------------

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "util_prefix_sum",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents,
      CAST(sum(cents) OVER (ORDER BY {', '.join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
      CAST(sum(cents) OVER (PARTITION BY l_returnflag ORDER BY {', '.join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING) AS BIGINT)
        AS running_flag
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
)
def _(t: Tables):
    cents = t.lineitem.select(
        *LINE_ORDER, "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents")
    )
    one = ordered.prefix_sum(cents, LINE_ORDER, {"running": "cents"})
    two = ordered.prefix_sum(one, LINE_ORDER, {"running_flag": "cents"}, series=["l_returnflag"])
    return two.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "running", "running_flag")


# ---- evaluation -----------------------------------------------------------------------------

STEPS["scored"] = (
    (),
    "SELECT doc_id, quality AS label, toxic AS pred, (n_chars % 997) / 997 AS score, lang "
    "FROM labels JOIN documents USING (doc_id)",
)


def scored(t: Tables):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return t.labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("pred"),
        ((F.col("n_chars") % 997) / 997).alias("score"), "lang",
    )


CONFUSION = """count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"""


@query("eval_confusion", f"SELECT lang, {CONFUSION} FROM scored GROUP BY lang", "scored")
def _(t: Tables):
    return evaluate.confusion(scored(t), "label", "pred", ["lang"])


@query(
    "eval_metrics",
    f"""SELECT lang, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END, 8) AS f1,
      round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END, 8) AS recall
    FROM (SELECT lang, {CONFUSION} FROM scored GROUP BY lang)""",
    "scored",
)
def _(t: Tables):
    m = evaluate.metrics(evaluate.confusion(scored(t), "label", "pred", ["lang"]), ["lang"])
    return m.select("lang", *[F.round(c, 8).alias(c) for c in ("accuracy", "f1", "recall")])


@query(
    "eval_auc",
    """WITH g AS (SELECT lang, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
      FROM scored GROUP BY 1, 2),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY score) - neg AS below FROM g)
    SELECT lang, round(sum(pos * (below + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 8) AS auc FROM c GROUP BY lang""",
    "scored",
)
def _(t: Tables):
    return evaluate.auc(scored(t), "label", "score", ["lang"]).withColumn("auc", F.round("auc", 8))


# ---- drift ----------------------------------------------------------------------------------

NUM = ["l_quantity", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus", "o_orderpriority"]


def _melted(cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, cur, yr FROM sides" for c in cols)


STEPS["sides"] = (
    (),
    "SELECT *, year(o_orderdate) = 2001 AS cur, CAST(year(o_orderdate) AS INT) AS yr "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
for _name, _cols in (("num_counts", NUM), ("cat_counts", CAT)):
    STEPS[_name] = (
        ("sides",),
        f"SELECT feature, value, count(*) FILTER (NOT cur) AS ref, count(*) FILTER (cur) AS cu FROM ({_melted(_cols)}) GROUP BY 1, 2",
    )
STEPS["num_stats"] = (
    ("num_counts",),
    """SELECT feature, n_ref, n_cur, sum(abs(cr / n_ref - cc / n_cur) * (nxt - value)) AS w,
      max(abs(cr / n_ref - cc / n_cur)) AS ks,
      sqrt(sum(ref * (value - mean) * (value - mean)) / max(n_ref)) AS sd
    FROM (SELECT *, sum(ref) OVER w AS cr, sum(cu) OVER w AS cc, lead(value) OVER w AS nxt,
      sum(ref) OVER a AS n_ref, sum(cu) OVER a AS n_cur, sum(ref * value) OVER a / sum(ref) OVER a AS mean
      FROM num_counts WINDOW w AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature))
    GROUP BY 1, 2, 3""",
)
STEPS["cat_stats"] = (
    ("cat_counts",),
    """SELECT feature, n_ref, n_cur, sum((cu - e) * (cu - e) / e) AS chi2, count(*) - 1 AS dof,
      sqrt((sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) / 2) AS js
    FROM (SELECT *, ref / n_ref AS p, cu / n_cur AS q, ref / n_ref * n_cur AS e FROM
      (SELECT *, sum(ref) OVER (PARTITION BY feature) AS n_ref, sum(cu) OVER (PARTITION BY feature) AS n_cur FROM cat_counts))
    GROUP BY 1, 2, 3""",
)
STEPS["flags"] = (
    ("num_stats", "cat_stats"),
    """SELECT feature, CAST(n_cur AS BIGINT) AS n_cur, 'wasserstein' AS test, round(w / greatest(sd, 0.001), 4) AS score,
      w / greatest(sd, 0.001) >= 0.1 AS drifted FROM num_stats
    UNION ALL SELECT feature, CAST(n_cur AS BIGINT), 'jensenshannon', round(js, 4), js >= 0.1 FROM cat_stats""",
)


def sides(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("yr"))
    return t.lineitem.select("l_orderkey", *NUM, *CAT[:2]).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def numeric_stats(t: Tables):
    return drift.distances(drift.side_counts(sides(t), NUM, F.col("yr") == 2001))


def categorical_stats(t: Tables):
    return drift.divergences(drift.side_counts(sides(t), CAT, F.col("yr") == 2001, "string"))


def flags(t: Tables):
    return drift.column_flags(numeric_stats(t), categorical_stats(t), test="distance")


@query(
    "drift_wasserstein",
    "SELECT feature, round(w, 6) AS wasserstein, round(w / greatest(sd, 0.001), 6) AS normed FROM num_stats",
    "num_stats",
)
def _(t: Tables):
    return numeric_stats(t).select(
        "feature", F.round("wasserstein", 6).alias("wasserstein"), F.round("wasserstein_normed", 6).alias("normed")
    )


@query("drift_ks", "SELECT feature, round(ks, 6) AS ks FROM num_stats", "num_stats")
def _(t: Tables):
    return numeric_stats(t).select("feature", F.round("ks", 6).alias("ks"))


@query("drift_chi2", "SELECT feature, round(chi2, 5) AS chi2, dof FROM cat_stats", "cat_stats")
def _(t: Tables):
    return categorical_stats(t).select("feature", F.round("chi2", 5).alias("chi2"), "dof")


@query("drift_js", "SELECT feature, round(js, 6) AS js FROM cat_stats", "cat_stats")
def _(t: Tables):
    return categorical_stats(t).select("feature", F.round("js", 6).alias("js"))


@query("drift_column_flag", "SELECT feature, test, score, drifted FROM flags", "flags")
def _(t: Tables):
    return flags(t).select("feature", "test", "score", "drifted")


DATASET = """SELECT count(*) FILTER (drifted) AS drifted_count, count(*) AS total_features,
  round(avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END), 3) AS drift_share,
  avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END) >= 0.5 AS drift_detected FROM flags"""


@query("drift_dataset", DATASET, "flags")
def _(t: Tables):
    return drift.dataset_drift(flags(t)).withColumn("drift_share", F.round("drift_share", 3))


LEVEL = "CASE WHEN {s} > 0.25 THEN 'CRITICAL' WHEN {s} > 0.10 THEN 'WARNING' ELSE 'OK' END"


@query(
    "drift_level",
    f"WITH d AS ({DATASET}) SELECT drift_share, {LEVEL.format(s='drift_share')} AS level FROM d",
    "flags",
)
def _(t: Tables):
    return drift.summary(flags(t)).select("drift_share", "level")


@query(
    "drift_summary",
    f"""WITH d AS ({DATASET}) SELECT 2001 AS year, d.*, {LEVEL.format(s='drift_share')} AS level,
      (SELECT max(n_cur) FROM flags) AS rows, (SELECT string_agg(feature, ',' ORDER BY feature) FROM flags) AS features,
      (SELECT round(sum(score), 3) FROM flags) AS score_sum FROM d""",
    "flags",
)
def _(t: Tables):
    s = drift.summary(flags(t))
    total = F.aggregate(F.map_values("feature_scores"), F.lit(0.0), lambda a, x: a + x)
    return s.select(
        F.lit(2001).alias("year"), "drifted_count", "total_features", "drift_share", "drift_detected", "level", "rows",
        F.array_join(F.array_sort(F.map_keys("feature_scores")), ",").alias("features"),
        F.round(total, 3).alias("score_sum"),
    )


@query(
    "drift_first_year",
    """SELECT CAST(min(year(o_orderdate)) AS INT) AS year, 0 AS rows, FALSE AS drift_detected, '' AS drifted_features
    FROM orders""",
)
def _(t: Tables):
    years = t.orders.select(F.year("o_orderdate").alias("year"))
    none = drift.first_year_summary(0)
    return years.agg(F.min("year").alias("year")).select(
        "year", F.lit(none["rows"]).alias("rows"), F.lit(none["drift_detected"]).alias("drift_detected"),
        F.lit(",".join(none["drifted_features"])).alias("drifted_features"),
    )


STEPS["series_counts"] = (
    ("sides",),
    f"""SELECT y.yr AS year, feature, value, count(*) FILTER (m.yr < y.yr) AS ref, count(*) FILTER (m.yr = y.yr) AS cu
    FROM ({_melted(NUM)}) m JOIN (SELECT DISTINCT yr FROM sides) y ON m.yr <= y.yr
    WHERE y.yr > (SELECT min(yr) FROM sides) GROUP BY 1, 2, 3""",
)
STEPS["series_stats"] = (
    ("series_counts",),
    """SELECT year, feature, sum(abs(cr / n_ref - cc / n_cur) * (nxt - value)) AS w,
      sqrt(sum(ref * (value - mean) * (value - mean)) / max(n_ref)) AS sd
    FROM (SELECT *, sum(ref) OVER w AS cr, sum(cu) OVER w AS cc, lead(value) OVER w AS nxt,
      sum(ref) OVER a AS n_ref, sum(cu) OVER a AS n_cur, sum(ref * value) OVER a / sum(ref) OVER a AS mean
      FROM series_counts WINDOW w AS (PARTITION BY year, feature ORDER BY value), a AS (PARTITION BY year, feature))
    GROUP BY 1, 2""",
)


def series_stats(t: Tables):
    counts = drift.by_year(sides(t).withColumnRenamed("yr", "year"), NUM, "year")
    return drift.distances(counts, ["year", "feature"])


@query(
    "drift_series",
    "SELECT year, feature, round(w, 6) AS wasserstein, round(w / greatest(sd, 0.001), 6) AS normed FROM series_stats",
    "series_stats",
)
def _(t: Tables):
    return series_stats(t).select(
        "year", "feature", F.round("wasserstein", 6).alias("wasserstein"),
        F.round("wasserstein_normed", 6).alias("normed"),
    )


def yearly_summaries(t: Tables):
    """Per year, on the three numeric features, with a limit low enough for some to be flagged."""
    num = series_stats(t).select(
        "year", "feature", "n_cur", F.round("wasserstein_normed", 4).alias("score"),
        (F.round("wasserstein_normed", 4) >= 0.02).alias("drifted"),
    )
    return drift.summary(num, ["year"])


STEPS["year_flags"] = (
    ("series_stats",),
    """SELECT year, feature, round(w / greatest(sd, 0.001), 4) AS score, round(w / greatest(sd, 0.001), 4) >= 0.02 AS drifted
    FROM series_stats""",
)
STEPS["year_summaries"] = (
    ("year_flags",),
    f"""SELECT *, {LEVEL.format(s='share')} AS level FROM (SELECT year, count(*) FILTER (drifted) AS drifted,
    count(*) AS total, round(avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END), 3) AS share FROM year_flags GROUP BY 1)""",
)


@query(
    "drift_gauge",
    """SELECT year, 'drift_level' AS name, '' AS feature, CASE level WHEN 'OK' THEN 0.0::DOUBLE WHEN 'WARNING' THEN 1 ELSE 2 END AS value
      FROM year_summaries
    UNION ALL SELECT year, 'drift_share', '', share FROM year_summaries
    UNION ALL SELECT year, 'drift_drifted_count', '', drifted FROM year_summaries
    UNION ALL SELECT year, 'drift_total_features', '', total FROM year_summaries
    UNION ALL SELECT year, 'drift_feature_score', feature, score FROM year_flags""",
    "year_summaries",
)
def _(t: Tables):
    return drift.gauges(yearly_summaries(t), ["year"])


@query(
    "drift_alert",
    """SELECT year, level, 'event=alert severity=' || lower(level) || ' topic=drift year=' || year || ' share='
      || printf('%.3f', share) || ' drifted=' || drifted AS line FROM year_summaries WHERE level <> 'OK'""",
    "year_summaries",
)
def _(t: Tables):
    return drift.alerts(yearly_summaries(t), "year")


@query(
    "rank_scores_desc",
    "SELECT feature, score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INT) AS place FROM flags",
    "flags",
)
def _(t: Tables):
    ranked = rank.scores_desc(flags(t).select("feature", "score"), "score", "feature")
    return ranked.withColumn("place", F.col("place").cast("int"))
