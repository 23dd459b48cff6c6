"""Promotion gates and champion selection over tables of candidate metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets

METRICS = tuple(presets.KPI_THRESHOLDS)


def kpi(df: DataFrame, thresholds: Mapping[str, float] = presets.KPI_THRESHOLDS) -> DataFrame:
    """Add the list of failed metrics and whether all limits hold; a missing metric counts as 0."""
    fails = F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(m), F.lit(0.0)) < limit, F.lit(m)) for m, limit in thresholds.items()])
    )
    return df.withColumn("fails", fails).withColumn("passed", F.size("fails") == 0)


def champion(
    candidates: DataFrame, keys: Sequence[str], name: str, metric: str = presets.PRIMARY_METRIC
) -> DataFrame:
    """Best passing candidate per group; groups in which none passes give no row."""
    row = F.struct(*[c for c in candidates.columns if c not in keys])
    best = F.min_by(row, F.struct((-F.col(metric)).alias("neg"), F.col(name).alias("name")))
    return kpi(candidates).filter("passed").groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def production_metrics(versions: DataFrame, alias: str = "alias") -> Column:
    """Metrics of the version in production as one scalar struct (NULL when there is none)."""
    live = versions.filter(F.col(alias) == "Production")
    return live.agg(F.max(F.struct("run_id", *METRICS))).scalar()


def regressions(prod: Column) -> Column:
    """How many metrics are below production."""
    return sum(((F.col(m) < prod[m]).cast("int") for m in METRICS), F.lit(0))


def policy(champions: DataFrame, prod: Column, mode: str) -> DataFrame:
    """Add ``promoted``: 'replay' always, 'newdata' unless two metrics regress, 'improve' with enough gain.

    Without a production model every champion is promoted.
    """
    gain = F.col(presets.PRIMARY_METRIC) - prod[presets.PRIMARY_METRIC]
    rule = {
        "replay": F.lit(True),
        "newdata": regressions(prod) < 2,
        "improve": gain >= presets.MIN_GAIN,
    }[mode]
    return champions.withColumn("promoted", prod.isNull() | F.coalesce(rule, F.lit(False)))


def wins_losses(candidates: DataFrame, prod: Column) -> DataFrame:
    """Metrics at or above production against those below; more losses block a passing candidate."""
    wins = sum(((F.col(m) >= prod[m]).cast("int") for m in METRICS), F.lit(0))
    losses = regressions(prod)
    return kpi(candidates).withColumns(
        {"wins": wins, "losses": losses, "blocked": F.coalesce(~F.col("passed") | (losses > wins), ~F.col("passed"))}
    )


def comparison(candidates: DataFrame, prod: Column) -> DataFrame:
    """One row per candidate and metric: production, candidate, delta and the decision with its reason."""
    gain = F.col(presets.PRIMARY_METRIC) - prod[presets.PRIMARY_METRIC]
    better = F.lit(True)
    for m in METRICS:
        better = better & (F.col(m) > prod[m])
    send = F.when(prod.isNull(), F.lit(True)).otherwise(F.col("passed") & (gain >= presets.MIN_GAIN))
    reason = (
        F.when(prod.isNull(), F.lit("no production model"))
        .when(~F.col("passed"), F.lit("limits not met"))
        .when(gain >= presets.MIN_GAIN, F.lit("gain is enough"))
        .otherwise(F.lit("gain is too small"))
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), prod[m].alias("prod"), F.col(m).alias("exp"), (F.col(m) - prod[m]).alias("delta")
            )
            for m in METRICS
        ]
    )
    decided = kpi(candidates).select(
        "run_id", better.alias("all_better"), send.alias("send_to_prod"), reason.alias("reason"), rows.alias("_m")
    )
    return decided.select("run_id", "all_better", "send_to_prod", "reason", F.inline("_m"))
