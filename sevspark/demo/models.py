"""Gates, champion policies and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions import when
from ..operators import gates, joins, rank, registry
from .base import Tables, query
from .raw import STEPS

METRICS = list(presets.KPI_THRESHOLDS)
PASS = " AND ".join(f"{m} >= {v}" for m, v in presets.KPI_THRESHOLDS.items())
FAILS = " || ".join(f"CASE WHEN {m} < {v} THEN '{m} ' ELSE '' END" for m, v in presets.KPI_THRESHOLDS.items())

STEPS["prod_runs"] = (("model_runs",), "SELECT * FROM model_runs WHERE experiment = 'prod'")
STEPS["versions"] = (
    ("prod_runs",),
    """SELECT *, row_number() OVER (ORDER BY promoted_at DESC NULLS LAST, algo || '_incidents', version) - 1 AS rk FROM prod_runs""",
)
STEPS["prod"] = (("versions",), "SELECT * FROM versions WHERE rk = 0")
STEPS["champions"] = (
    ("model_runs", "prod"),
    f"""SELECT date_trunc('hour', start_time) AS cycle, run_id, algo, f1, auc, accuracy, recall FROM model_runs WHERE {PASS}
    QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', start_time) ORDER BY f1 DESC, run_id) = 1""",
)
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def runs(t: Tables):
    """Run table with the params, metrics and tags maps of a tracking store."""
    def pairs(d: dict):
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])

    r = t.model_runs
    return r.select(
        "run_id", "experiment", "start_time", "algo", "version", "promoted_at", *METRICS,
        pairs(
            {"algorithm": F.col("algo"), "years": F.col("years"), "max_depth": F.col("param"),
             "n_train": F.lit("100"), "learning_rate": F.lit("0.1")}
        ).alias("params"),
        pairs({"f1_score": F.col("f1"), "auc": F.col("auc"), "accuracy": F.col("accuracy"),
               "recall": F.col("recall")}).alias("metrics"),
        pairs({"export_to_prod": F.col("export"), "gate_outcome": F.col("gate_outcome"),
               "model_name": F.col("algo")}).alias("tags"),
    )


def versions(t: Tables):
    """Model versions of the official experiment; the newest promotion holds the alias."""
    v = runs(t).filter("experiment = 'prod'").withColumn("model", F.concat("algo", F.lit("_incidents")))
    first = v.filter("promoted_at IS NOT NULL").agg(
        F.min_by(F.struct("model", "version"), F.struct((-F.col("promoted_at")).alias("n"), "model", "version"))
    ).scalar()
    live = (F.col("model") == first["model"]) & (F.col("version") == first["version"])
    return v.withColumn("alias", F.when(live, F.lit("Production")))


def champions(t: Tables):
    cand = t.model_runs.select(F.date_trunc("hour", "start_time").alias("cycle"), "run_id", "algo", *METRICS)
    return gates.champion(cand, ["cycle"], "run_id")


@query(
    "gate_kpi",
    f"SELECT run_id, trim({FAILS}) AS fails, ({PASS}) AS passed FROM model_runs",
    "model_runs",
)
def _(t: Tables):
    return gates.kpi(t.model_runs).select("run_id", F.array_join("fails", " ").alias("fails"), "passed")


@query("gate_champion", f"SELECT {STAMP.format('cycle')} AS cycle, run_id, algo, f1 FROM champions", "champions")
def _(t: Tables):
    return champions(t).select(when.stamp(F.col("cycle")).alias("cycle"), "run_id", "algo", "f1")


REGRESS = " + ".join(f"CASE WHEN c.{m} < p.{m} THEN 1 ELSE 0 END" for m in METRICS)
WINS = " + ".join(f"CASE WHEN c.{m} >= p.{m} THEN 1 ELSE 0 END" for m in METRICS)


def _policy(mode: str, rule: str):
    @query(
        f"gate_policy_{mode}",
        f"SELECT {STAMP.format('cycle')} AS cycle, c.run_id, ({rule}) AS promoted FROM champions c, prod p",
        "champions",
    )
    def _(t: Tables):
        df = gates.policy(champions(t), gates.production_metrics(versions(t)), mode)
        return df.select(when.stamp(F.col("cycle")).alias("cycle"), "run_id", "promoted")


_policy("replay", "TRUE")
_policy("newdata", f"{REGRESS} < 2")
_policy("improve", "c.f1 - p.f1 >= 0.01")


@query(
    "gate_wins_losses",
    f"""SELECT *, NOT passed OR losses > wins AS blocked FROM (SELECT c.run_id, {PASS.replace(' AND ', ' AND c.').replace('f1', 'c.f1', 1)} AS passed,
      CAST({WINS} AS INT) AS wins, CAST({REGRESS} AS INT) AS losses FROM model_runs c, prod p)""",
    "model_runs prod",
)
def _(t: Tables):
    df = gates.wins_losses(t.model_runs, gates.production_metrics(versions(t)))
    return df.select("run_id", "passed", "wins", "losses", "blocked")


_better = " AND ".join(f"c.{m} > p.{m}" for m in METRICS)
_pass_c = " AND ".join(f"c.{m} >= {v}" for m, v in presets.KPI_THRESHOLDS.items())


@query(
    "eval_compare",
    " UNION ALL ".join(
        f"""SELECT c.run_id, '{m}' AS metric, p.{m} AS prod, c.{m} AS exp, round(c.{m} - p.{m}, 6) AS delta, ({_better}) AS all_better,
        ({_pass_c} AND c.f1 - p.f1 >= 0.01) AS send_to_prod, CASE WHEN NOT ({_pass_c}) THEN 'limits not met'
        WHEN c.f1 - p.f1 >= 0.01 THEN 'gain is enough' ELSE 'gain is too small' END AS reason FROM champions c, prod p"""
        for m in METRICS
    ),
    "champions",
)
def _(t: Tables):
    df = gates.comparison(champions(t), gates.production_metrics(versions(t)))
    return df.select("run_id", "metric", "prod", "exp", F.round("delta", 6).alias("delta"), "all_better", "send_to_prod", "reason")


# ---- registry -------------------------------------------------------------------------------


@query(
    "join_registry",
    "SELECT version, algo, f1 FROM model_runs WHERE experiment = 'prod'",
    "model_runs",
)
def _(t: Tables):
    r = runs(t)
    all_versions = r.select("run_id", "version")
    return joins.versions_with_runs(all_versions, r.drop("version"), "prod").select("version", "algo", "f1")


@query(
    "reg_promote",
    """SELECT algo || '_incidents' AS model, version, CASE WHEN c THEN 'Production' END AS alias,
      CASE WHEN c THEN 1e9::DOUBLE ELSE promoted_at END AS promoted_at
    FROM (SELECT *, version = max(version) OVER () AS c FROM prod_runs)""",
    "prod_runs",
)
def _(t: Tables):
    v = versions(t)
    best = v.agg(F.max(F.struct("version", "model"))).scalar()
    df = registry.promote(v, best["model"], best["version"], F.lit(1e9))
    return df.select("model", "version", "alias", "promoted_at")


@query(
    "reg_rollback",
    "SELECT algo || '_incidents' AS model, version, CASE WHEN rk = 1 THEN 'Production' END AS alias, promoted_at FROM versions",
    "versions",
)
def _(t: Tables):
    return registry.rollback(versions(t)).select("model", "version", "alias", "promoted_at")


@query(
    "rank_promotions",
    """SELECT algo || '_incidents' AS model, version, rk AS rank, CASE WHEN rk = 0 THEN 'production' ELSE 'prod -' || rk END AS label
    FROM versions WHERE promoted_at IS NOT NULL""",
    "versions",
)
def _(t: Tables):
    df = registry.promotion_ranks(versions(t))
    return df.select(
        "model", "version", "rank", registry.production_label(F.col("alias"), F.col("rank")).alias("label")
    )


STEPS["registry_table"] = (
    ("versions",),
    r"""SELECT algo || ':v' || version AS version, CASE WHEN yr = '?' THEN 'year=?' ELSE 'data-v' || (CAST(yr AS INT) - 2020) END AS data,
      yr AS year, len(ys) > 1 AS cumulative, algo, round(f1, 4) AS f1, round(auc, 4) AS auc, round(accuracy, 4) AS accuracy,
      round(recall, 4) AS recall, CASE WHEN rk = 0 THEN 'production' WHEN promoted_at IS NOT NULL THEN 'prod -' || rk ELSE 'no' END AS production,
      CASE WHEN gate_outcome = 'stopped' THEN 'stopped (T3)' ELSE '' END AS status
    FROM (SELECT *, COALESCE(list_max(ys), '?') AS yr FROM (SELECT *, regexp_extract_all(COALESCE(years, ''), '\d{4}') AS ys FROM versions))""",
)


@query("reg_table", "SELECT * FROM registry_table", "registry_table")
def _(t: Tables):
    return registry.table(versions(t))


@query(
    "reg_current",
    "SELECT version, f1, auc, accuracy, recall, 1 AS info FROM registry_table WHERE production = 'production'",
    "registry_table",
)
def _(t: Tables):
    return registry.current(registry.table(versions(t))).select("version", *METRICS, "info")


@query(
    "rank_keep_newest",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY start_time DESC, run_id DESC) AS rn FROM model_runs)
    SELECT run_id, algo FROM r WHERE rn > 50 AND run_id NOT IN (SELECT run_id FROM prod)""",
    "model_runs prod",
)
def _(t: Tables):
    protected = versions(t).filter("alias = 'Production'").select("run_id")
    return rank.keep_newest(t.model_runs, "algo", "start_time", "run_id", 50, protected).select("run_id", "algo")


_TYPE = """CASE WHEN {v} IN ('True', 'False') THEN 'bool' WHEN {v} = 'None' THEN 'none' WHEN regexp_full_match({v}, '[0-9]+') THEN 'int'
  WHEN TRY_CAST({v} AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END"""


@query(
    "ml_param_coerce",
    f"""WITH p AS (SELECT run_id, 'max_depth' AS param, param AS value FROM model_runs
      UNION ALL SELECT run_id, 'learning_rate', '0.1' FROM model_runs UNION ALL SELECT run_id, 'n_train', '100' FROM model_runs
      UNION ALL SELECT run_id, 'algorithm', algo FROM model_runs UNION ALL SELECT run_id, 'years', years FROM model_runs)
    SELECT run_id, param, value, {_TYPE.format(v='value')} AS type, TRY_CAST(value AS DOUBLE) AS number FROM p""",
    "model_runs",
)
def _(t: Tables):
    return registry.typed_params(runs(t)).drop("flag")


@query(
    "ml_select_run",
    """SELECT run_id, 'learning_rate=0.1,max_depth=' || param AS params FROM model_runs WHERE export = 'true'
    ORDER BY start_time DESC, run_id DESC LIMIT 1""",
    "model_runs",
)
def _(t: Tables):
    df = registry.tagged_newest(runs(t), "export_to_prod", "true")
    shown = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("run_id", F.array_join(shown, ",").alias("params"))
