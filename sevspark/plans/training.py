"""Feature table -> models, metrics, champion; expanding-window replay of past years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..operators import boosting, forest, gates, ml
from ..session import cut
from . import feature_table

ALGORITHMS = ("rf", "gbt_depth", "gbt_leaf")


def train_and_test(
    split: DataFrame, algo: str, label: str = "grav", overrides: Mapping | None = None,
    features: Sequence[str] = presets.MODEL_FEATURES,
) -> tuple[forest.Forest | boosting.Boosted, DataFrame]:
    """Model of the train rows and its one-row metrics on the test rows."""
    train = ml.training_frame(split.filter("split = 'train'"), features, label, algo).persist()
    try:
        model = ml.fit(train, algo, overrides)
    finally:
        train.unpersist()
    scored = ml.score(model, split.filter("split = 'test'").select(*features, label), features)
    return model, ml.test_metrics(scored, label).withColumn("algo", F.lit(algo))


def candidates(
    split: DataFrame, overrides: Mapping[str, Mapping] | None = None, algorithms: Sequence[str] = ALGORITHMS
) -> tuple[dict[str, forest.Forest | boosting.Boosted], DataFrame]:
    """All models and their metrics, one row per algorithm; the split is materialised once."""
    split = cut(split)
    models, rows = {}, None
    for algo in algorithms:
        models[algo], m = train_and_test(split, algo, overrides=(overrides or {}).get(algo))
        rows = m if rows is None else rows.unionByName(m)
    return models, rows


def champion(metrics: DataFrame) -> DataFrame:
    return gates.champion(metrics.withColumn("_all", F.lit(1)), ["_all"], "algo").drop("_all")


def cycles(
    features: DataFrame, algo: str, year: str = "year_acc", overrides: Mapping | None = None
) -> DataFrame:
    """For every year after the first: train on all earlier years, test on that year.

    The driver loops over the years, a handful; each fit is distributed.
    """
    rows = cut(features)
    years = sorted(r[year] for r in rows.select(year).distinct().collect())
    out = None
    for last in years[1:]:
        split = feature_table.train_test(rows.filter(F.col(year) <= last), year)
        _, m = train_and_test(split, algo, overrides=overrides)
        m = m.withColumns({"year": F.lit(last), "label": F.lit(feature_table.dataset_label(y for y in years if y <= last))})
        out = m if out is None else out.unionByName(m)
    if out is None:
        raise ValueError("at least two years are needed")
    return out
