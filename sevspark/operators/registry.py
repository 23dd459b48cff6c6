"""The model registry as two plain tables: ``runs`` and ``model_versions``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions import text
from .ordered import row_index

LIVE = "Production"


def promote(versions: DataFrame, model: Column, version: Column, at: Column) -> DataFrame:
    """Give the alias to exactly one version, clear all others and stamp the time."""
    chosen = F.coalesce((F.col("model") == model) & (F.col("version") == version), F.lit(False))
    return versions.withColumns(
        {"alias": F.when(chosen, F.lit(LIVE)), "promoted_at": F.when(chosen, at).otherwise(F.col("promoted_at"))}
    )


def previous_promotion(versions: DataFrame) -> Column:
    """Struct of the version promoted before the current one (the second newest)."""
    newest = versions.filter(F.col("promoted_at").isNotNull()).orderBy(
        F.col("promoted_at").desc(), F.col("version").desc()
    ).limit(2)
    pair = newest.agg(F.array_sort(F.collect_list(F.struct("promoted_at", "version", "model"))).alias("p"))
    return pair.select(F.when(F.size("p") > 1, F.col("p")[0])).scalar()


def live_version(versions: DataFrame) -> tuple[str, int] | None:
    """Model and version that hold the alias now: what a deployment saves before it promotes another."""
    row = versions.filter(F.col("alias") == LIVE).select("model", "version").first()
    return (row["model"], row["version"]) if row else None


def rollback(versions: DataFrame, saved: tuple[str, int] | None = None) -> DataFrame:
    """Hand the alias back to the ``saved`` model and version; promotion times stay.

    Without one it goes to the version promoted before the newest, which is the same only right after a promotion.
    """
    if saved:
        model, version = F.lit(saved[0]), F.lit(saved[1])
    else:
        back = previous_promotion(versions)
        model, version = back["model"], back["version"]
    chosen = F.coalesce((F.col("model") == model) & (F.col("version") == version), F.lit(False))
    return versions.withColumn("alias", F.when(chosen, F.lit(LIVE)))


def promotion_ranks(versions: DataFrame, keys: Sequence[str] = ("model", "version")) -> DataFrame:
    """0 for the newest promotion, 1 for the one before, and so on, over all families."""
    done = versions.filter(F.col("promoted_at").isNotNull()).withColumn("_neg", -F.col("promoted_at"))
    ranked = row_index(done, ["_neg", *keys], "_i", unique=True)
    return ranked.withColumn("rank", F.col("_i") - 1).drop("_i", "_neg")


def production_label(alias: Column, rank: Column) -> Column:
    return (
        F.when(alias == LIVE, F.lit("production"))
        .when(rank > 0, F.concat(F.lit("prod -"), rank.cast("string")))
        .otherwise(F.lit("no"))
    )


def newest_year(years: Column) -> Column:
    """Largest four-digit number in the text, '?' when there is none."""
    found = F.regexp_extract_all(years, F.lit(r"\d{4}"), F.lit(0))
    return F.coalesce(F.array_max(found), F.lit("?"))


def is_cumulative(years: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(years, F.lit(r"\d{4}"), F.lit(0))) > 1, F.lit(False))


def data_label(year: Column) -> Column:
    n = year.try_cast("int") - (presets.FIRST_YEAR - 1)
    return F.when(n >= 1, F.concat(F.lit("data-v"), n.cast("string"))).otherwise(F.concat(F.lit("year="), year))


def metric(m: Column, *names: str) -> Column:
    """First metric present under one of the names, 0 when none, 4 decimals."""
    return F.round(F.coalesce(*[m[n] for n in names], F.lit(0.0)), 4)


def table(versions_with_runs: DataFrame) -> DataFrame:
    """Readable version list; expects model, version, alias, promoted_at, params, metrics, tags."""
    ranks = promotion_ranks(versions_with_runs).select("model", "version", "rank")
    p, m = F.col("params"), F.col("metrics")
    year = newest_year(p["years"])
    algo = F.coalesce(p["algorithm"], F.split(F.col("model"), "_")[0])
    return versions_with_runs.join(ranks, ["model", "version"], "left").select(
        F.concat(algo, F.lit(":v"), F.col("version").cast("string")).alias("version"),
        data_label(year).alias("data"), year.alias("year"), is_cumulative(p["years"]).alias("cumulative"),
        algo.alias("algo"), metric(m, "f1_score", "f1").alias("f1"), metric(m, "roc_auc", "auc").alias("auc"),
        metric(m, "accuracy").alias("accuracy"), metric(m, "recall").alias("recall"),
        production_label(F.col("alias"), F.col("rank")).alias("production"),
        F.when(F.col("tags")["gate_outcome"] == "stopped", F.lit("stopped (T3)")).otherwise(F.lit("")).alias("status"),
    )


def current(versions_table: DataFrame) -> DataFrame:
    """The production row with its (model, version) gauge."""
    return versions_table.filter(F.col("production") == "production").withColumn("info", F.lit(1))


def tagged_newest(runs: DataFrame, tag: str, value: str, drop: Sequence[str] = presets.META_PARAMS) -> DataFrame:
    """Newest run carrying the tag, with its parameters but without the bookkeeping ones."""
    hit = runs.filter(F.col("tags")[tag] == value)
    newest = F.max_by(F.struct("run_id", "params"), F.struct("start_time", "run_id"))
    kept = F.map_filter(F.col("r.params"), lambda k, _: ~k.isin(list(drop)))
    return hit.agg(newest.alias("r")).filter("r IS NOT NULL").select("r.run_id", kept.alias("params"))


def typed_params(runs: DataFrame) -> DataFrame:
    """One row per run and parameter: its text, the type the text stands for, and the value as ``number`` or ``flag``."""
    rows = runs.select("run_id", F.explode("params").alias("param", "value"))
    rows = rows.withColumn("type", text.typed_text(F.col("value")))
    number = F.when(F.col("type").isin("int", "float"), F.col("value").try_cast("double"))
    return rows.withColumns({"number": number, "flag": F.when(F.col("type") == "bool", F.col("value") == "True")})
