"""Classifier training and scoring with Spark ML."""

from __future__ import annotations

import itertools
import random
import statistics
from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from . import aggregate, boosting, evaluate, forest

MAX_DEPTH = 30  # the deepest tree Spark builds; stands for "no limit"
MISSING = -1.0  # how a missing feature enters the vector
BOOSTED = ("gbt_depth", "gbt_leaf")


# ---- parameters -----------------------------------------------------------------------------


def merge_params(
    blueprint: Mapping, overrides: Mapping | None = None, defaults: Mapping | None = None, infra: Mapping | None = None
) -> dict:
    """override > blueprint > default; infrastructure settings always win."""
    return {**(defaults or {}), **blueprint, **(overrides or {}), **(infra or {})}


def merge_param_maps(*layers: Column) -> Column:
    """The same for map columns, later layers winning."""
    out = layers[0]
    for layer in layers[1:]:
        out = F.map_zip_with(out, layer, lambda _, low, high: F.coalesce(high, low))
    return out


def _subset(value) -> str:
    return {None: "auto", "sqrt": "sqrt"}.get(value, str(value))


def build(algo: str, params: Mapping, label: str = "label", weight: str | None = None, seed: int = 42):
    """Spark's estimator of a forest, which names its parameters; ``forest`` fits them, ``boosting`` those of the boosted families."""
    common = {"featuresCol": "features", "labelCol": label, "seed": seed}
    if weight and params.get("class_weight") == "balanced":
        common["weightCol"] = weight
    depth = params.get("max_depth") or MAX_DEPTH
    if algo == "rf":
        return RandomForestClassifier(
            numTrees=params["n_estimators"], maxDepth=min(depth, MAX_DEPTH),
            minInstancesPerNode=params["min_samples_leaf"], impurity=params["criterion"],
            featureSubsetStrategy=_subset(params["max_features"]),
            **common,
        )
    raise ValueError(f"unknown algorithm {algo}")


def boosting_params(algo: str, params: Mapping, seed: int = 42) -> boosting.Params:
    """The published parameters of a boosted family; ``depth``-wise ones regularise by 1 unless told otherwise."""
    common = dict(
        rounds=params["n_estimators"], rate=params["learning_rate"], row_share=params["subsample"], column_share=params["colsample_bytree"],
        l1=params.get("reg_alpha", 0.0), gamma=params.get("gamma", params.get("min_split_gain", 0.0)), seed=seed,
    )
    if algo == "gbt_depth":
        return boosting.Params(depth=params["max_depth"], l2=params.get("reg_lambda", 1.0), min_hessian=params["min_child_weight"], **common)
    depth = params.get("max_depth")
    return boosting.Params(
        leaves=params["num_leaves"], depth=depth if depth and depth > 0 else None, l2=params.get("reg_lambda", 0.0),
        min_rows=params["min_child_samples"], min_hessian=params.get("min_child_weight", 1e-3), **common,
    )


# ---- frames ---------------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str], target: str = "features") -> DataFrame:
    """Feature vector in the given order; a missing value enters as MISSING."""
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})
    inputs = [f"_f_{c}" for c in features]
    return VectorAssembler(inputCols=inputs, outputCol=target).transform(filled).drop(*inputs)


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weight per row, from one aggregate used as a scalar map (one entry per class)."""
    weights = aggregate.class_weights(df, label)
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.withColumn(name, table[F.col(label)])


def training_frame(df: DataFrame, features: Sequence[str], label: str, algo: str = "rf") -> DataFrame:
    """``features, label, weight`` only: what an estimator scans again and again. Boosted families take ``values``, with nulls."""
    if algo in BOOSTED:
        rows = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("values"), F.col(label).cast("double").alias("label"))
    else:
        rows = assemble(df, features).select("features", F.col(label).cast("double").alias("label"))
    return with_class_weight(rows, "label")


# ---- training and scoring -------------------------------------------------------------------


def fit(train: DataFrame, algo: str, overrides: Mapping | None = None, seed: int = 42) -> forest.Forest | boosting.Boosted:
    params = merge_params(presets.MODEL_PARAMS[algo], overrides)
    if algo in BOOSTED:
        weight = "weight" if params.get("class_weight") == "balanced" else None
        return boosting.fit(train, boosting_params(algo, params, seed), weight)
    est = build(algo, params, weight="weight", seed=seed)
    asked = forest.Params(
        est.getNumTrees(), est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMinInfoGain(), est.getImpurity(), est.getFeatureSubsetStrategy(), seed
    )
    return forest.fit(train, asked, est.getWeightCol() if est.isSet("weightCol") else None)


def score(model: Model | forest.Forest | boosting.Boosted, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add class, probability of the predicted class (4 decimals) and of the severe class."""
    if isinstance(model, boosting.Boosted):
        p = F.col("severe_probability")
        keep = [c for c in df.columns if c not in {"prediction", "probability", "severe_probability"}]
        cls = (p > 0.5).cast("int")
        return model.score(df, features).select(
            *keep, cls.alias("prediction"), F.round(F.greatest(p, 1 - p), 4).alias("probability"), "severe_probability"
        )
    keep = [c for c in df.columns if c not in {"prediction", "probability"}]
    if isinstance(model, forest.Forest):
        out = model.score(assemble(df, features), "features", "_shares")
        p = F.col("_shares")
        # of equal shares the first class
        cls = F.array_position(p, F.array_max(p)).cast("int") - 1
    else:
        out = model.transform(assemble(df, features))
        p = vector_to_array("probability")
        cls = F.col("prediction").cast("int")
    return out.select(
        *keep, cls.alias("prediction"), F.round(F.get(p, cls), 4).alias("probability"),
        F.get(p, F.lit(1)).alias("severe_probability"),
    )


def test_metrics(scored: DataFrame, label: str) -> DataFrame:
    """accuracy, f1, recall and auc of a scored table, as one row."""
    base = evaluate.metrics(evaluate.confusion(scored, label, "prediction"))
    return base.withColumn("auc", evaluate.auc(scored, label, "severe_probability").scalar())


def importances(model: Model, features: Sequence[str], n: int = 8) -> list[tuple[str, float]]:
    """Features by falling importance; as many values as the model has features."""
    ranked = sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
    return ranked[:n]


def logistic(train: DataFrame) -> Model:
    return LogisticRegression(labelCol="label", weightCol="weight", maxIter=100).fit(train)


def tree(train: DataFrame, impurity: str, depth: int, seed: int) -> Model:
    return DecisionTreeClassifier(labelCol="label", impurity=impurity, maxDepth=depth, seed=seed).fit(train)


def select_by_median(train: DataFrame, features: Sequence[str]) -> list[tuple[str, float, bool]]:
    """Features whose absolute coefficient in a linear model reaches the median."""
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train).transform(train)
    model = LinearSVC(featuresCol="scaled", labelCol="label", maxIter=50).fit(scaled)
    size = [abs(float(c)) for c in model.coefficients.toArray()]
    middle = statistics.median(size)
    return [(f, s, s >= middle) for f, s in zip(features, size)]


# --- fixed values ---
GRID = {
    "numTrees": [50, 100, 200],
    "maxDepth": [MAX_DEPTH, 10, 20],
    "minInfoGain": [0.0, 0.001, 0.01],
    "minInstancesPerNode": [1, 2, 4],
}
# --- end of fixed values ---


def _search(train: DataFrame, points: Sequence[Mapping], folds: int, parallelism: int, seed: int) -> list[tuple]:
    if all(set(p) <= {*forest.OWN, *forest.HEADS} for p in points):
        marks = forest.search(train, points, folds, seed)
    else:
        marks = _cross_validated(train, points, folds, parallelism, seed)
    ranked = sorted(zip(points, marks), key=lambda x: -x[1])
    return [(str(dict(p)), float(m)) for p, m in ranked]


def _cross_validated(train: DataFrame, points: Sequence[Mapping], folds: int, parallelism: int, seed: int) -> list[float]:
    """The same by Spark's own forests, for parameters that ``forest`` does not have."""
    est = RandomForestClassifier(labelCol="label", seed=seed)
    maps = [{est.getParam(k): v for k, v in p.items()} for p in points]
    evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed
    )
    return cv.fit(train).avgMetrics


def grid_search(
    train: DataFrame, grid: Mapping[str, Sequence] = GRID, folds: int = 5, parallelism: int = 4, seed: int = 42
) -> list[tuple]:
    """Every point of the grid by cross-validated F1, best first."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return _search(train, points, folds, parallelism, seed)


def random_search(
    train: DataFrame, grid: Mapping[str, Sequence] = GRID, draws: int = 20, folds: int = 3, parallelism: int = 4,
    seed: int = 42,
) -> list[tuple]:
    """A random subset of the grid's points, best first."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    chosen = random.Random(seed).sample(points, min(draws, len(points)))
    return _search(train, chosen, folds, parallelism, seed)
