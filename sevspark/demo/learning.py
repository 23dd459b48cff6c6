"""Training, scoring, replay and scored what-if queries (models: no SQL counterpart)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from .. import presets
from ..operators import ml, whatif
from ..plans import feature_table, replay, training
from ..session import cut, work_path
from .base import Tables, query
from .intake import PAYLOAD_FIELDS
from .tables import feature_rows

FEATURES = presets.MODEL_FEATURES


@lru_cache(maxsize=4)
def _split(app: str, folder: str, spark):
    t = Tables(spark, folder)
    return cut(feature_table.train_test(feature_rows(t)))


def split_table(t: Tables):
    """The imputed train/test table, materialised once per session and folder."""
    return _split(t.spark.sparkContext.applicationId, t.folder, t.spark)


@lru_cache(maxsize=8)
def _model(app: str, folder: str, spark, algo: str):
    return training.train_and_test(split_table(Tables(spark, folder)), algo)


def model(t: Tables, algo: str = "rf"):
    return _model(t.spark.sparkContext.applicationId, t.folder, t.spark, algo)


def train_frame(t: Tables):
    return ml.training_frame(split_table(t).filter("split = 'train'"), FEATURES, "grav")


def predict(t: Tables):
    fitted = model(t)[0]
    return lambda df: ml.score(fitted, df, FEATURES)


for _algo in training.ALGORITHMS:

    def _run(t: Tables, algo=_algo):
        return model(t, algo)[1].select("algo", *[F.round(c, 4).alias(c) for c in ("accuracy", "f1", "auc", "recall")])

    query(f"ml_train_{_algo}")(_run)


@query(
    "ml_param_merge",
    """SELECT run_id, param AS max_depth, '0.1' AS learning_rate, '300' AS n_estimators, '-1' AS n_jobs, '6' AS num_leaves
    FROM model_runs""",
    "model_runs",
)
def _(t: Tables):
    from .models import runs

    def layer(**kw):
        return F.create_map(*[F.lit(x) for pair in kw.items() for x in pair])

    merged = ml.merge_param_maps(
        layer(n_estimators="100", max_depth="3", num_leaves="6", n_jobs="1"), layer(n_estimators="300", learning_rate="0.05"),
        F.map_filter("params", lambda k, _: ~k.isin(presets.META_PARAMS)), layer(n_jobs="-1"),
    )
    return runs(t).select("run_id", merged.alias("p")).select(
        "run_id", *[F.col("p")[k].alias(k) for k in ("max_depth", "learning_rate", "n_estimators", "n_jobs", "num_leaves")]
    )


@query("ml_logreg")
def _(t: Tables):
    fitted = ml.logistic(train_frame(t).persist())
    scored = ml.score(fitted, split_table(t).filter("split = 'test'"), FEATURES)
    return scored.groupBy("grav", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("ml_tree")
def _(t: Tables):
    train = train_frame(t).persist()
    test = split_table(t).filter("split = 'test'")
    out = None
    for impurity, depth, seed in (("entropy", 4, 123), ("gini", 8, 321)):
        scored = ml.score(ml.tree(train, impurity, depth, seed), test, FEATURES)
        one = ml.test_metrics(scored, "grav").select(F.lit(impurity).alias("impurity"), F.round("f1", 4).alias("f1"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ml_feature_select")
def _(t: Tables):
    rows = ml.select_by_median(train_frame(t), FEATURES)
    return t.spark.createDataFrame(rows, "feature string, size double, selected boolean")


@query("ml_importance")
def _(t: Tables):
    return t.spark.createDataFrame(ml.importances(model(t)[0], FEATURES), "feature string, importance double")


@query("ml_grid_search")
def _(t: Tables):
    found = ml.grid_search(train_frame(t).persist())
    return t.spark.createDataFrame(found, "params string, f1 double")


@query("ml_random_search")
def _(t: Tables):
    return t.spark.createDataFrame(ml.random_search(train_frame(t).persist()), "params string, f1 double")


@query("ml_predict_batch")
def _(t: Tables):
    return predict(t)(split_table(t).filter("split = 'test'")).select("Num_Acc", "prediction", "probability")


@query("ml_predict_examples")
def _(t: Tables):
    cases = split_table(t).select("Num_Acc", *FEATURES)
    return predict(t)(cases).select("Num_Acc", "vma", "hour", "prediction", "probability")


_VALID = " AND ".join(f'"{f}" IS NOT NULL' for f in PAYLOAD_FIELDS)


@query(
    "ml_replay",
    f"""SELECT 'full' AS run, count(*) FILTER ({_VALID}) AS sent, count(*) FILTER (NOT ({_VALID})) AS errors,
      CAST(0 AS BIGINT) AS would_send, count(*) FILTER (NOT ({_VALID})) / count(*) < 0.05 AS ok FROM imputed WHERE split = 'test'
    UNION ALL SELECT 'dry', 0, 0, count(*), TRUE FROM imputed WHERE split = 'test' AND mois = 6""",
    "imputed",
)
def _(t: Tables):
    rows = split_table(t).filter("split = 'test'")
    todo = replay.prepare(rows, FEATURES, ["Num_Acc"])
    done = replay.replay(
        todo, ["Num_Acc"], PAYLOAD_FIELDS, predict(t), work_path(t.spark, "replay"), "rf:v1", "2024-05"
    )
    dry = replay.replay(
        replay.prepare(rows, FEATURES, ["Num_Acc"], "2024-06"), ["Num_Acc"], PAYLOAD_FIELDS, predict(t), "", "rf:v1",
        dry_run=True,
    )
    return done.withColumn("run", F.lit("full")).unionByName(dry.withColumn("run", F.lit("dry")))


@query("ml_cycles")
def _(t: Tables):
    df = training.cycles(feature_rows(t), "rf")
    return df.select("year", "label", *[F.round(c, 4).alias(c) for c in ("accuracy", "f1", "auc", "recall")])


def scenario_table(t: Tables):
    return split_table(t).filter("split = 'test'").withColumn("intersection_type", F.col("int"))


def scenario_predict(t: Tables):
    score = predict(t)
    return lambda df: score(df.withColumn("int", F.col("intersection_type")))


@query("whatif_delta")
def _(t: Tables):
    out = None
    for name, s in whatif.SCENARIOS.items():
        before, after = whatif.apply(scenario_table(t), name, ["Num_Acc"], 2.0)
        one = whatif.delta(before, after, scenario_predict(t)).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("whatif_pair")
def _(t: Tables):
    df = whatif.pair(scenario_table(t), "Num_Acc", "vma", 90, 50, scenario_predict(t))
    return df.select("Num_Acc", *[F.round(c, 4).alias(c) for c in ("p_high", "p_low", "delta")])


