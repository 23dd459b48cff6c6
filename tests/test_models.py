import pytest
from pyspark.sql import functions as F

from sevspark.operators import gates, ml, registry, whatif

GOOD = (0.65, 0.80, 0.75, 0.60)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "run_id string, algo string, f1 double, auc double, accuracy double, recall double")


def prod(spark, *m):
    return spark.createDataFrame([("p", *m, "Production")], "run_id string, f1 double, auc double, accuracy double, recall double, alias string")


def test_champion_needs_all_limits(spark):
    df = candidates(spark, [("a", "rf", *GOOD), ("b", "x", 0.70, 0.80, 0.75, 0.50), ("c", "y", 0.64, 0.9, 0.9, 0.9)])
    got = gates.champion(df.withColumn("g", F.lit(1)), ["g"], "run_id").first()
    assert got["run_id"] == "a"
    none = candidates(spark, [("b", "x", 0.1, 0.1, 0.1, 0.1)]).withColumn("g", F.lit(1))
    assert gates.champion(none, ["g"], "run_id").count() == 0


@pytest.mark.parametrize(
    "mode, production, promoted",
    [
        ("replay", (0.9, 0.9, 0.9, 0.9), True),
        ("newdata", (0.70, 0.79, 0.70, 0.55), True),
        ("newdata", (0.70, 0.85, 0.70, 0.55), False),
        ("improve", (0.645, 0.8, 0.8, 0.8), False),
        ("improve", (0.60, 0.9, 0.9, 0.9), True),
    ],
)
def test_policies(spark, mode, production, promoted):
    df = candidates(spark, [("a", "rf", *GOOD)])
    assert gates.policy(df, gates.production_metrics(prod(spark, *production)), mode).first()["promoted"] is promoted


def test_no_production_promotes(spark):
    df = candidates(spark, [("a", "rf", *GOOD)])
    empty = gates.production_metrics(prod(spark, *GOOD).filter("1 = 0"))
    assert gates.policy(df, empty, "improve").first()["promoted"] is True
    assert gates.comparison(df, empty).filter("send_to_prod").count() == 4
    assert gates.wins_losses(df, empty).first()["blocked"] is False


def test_wins_and_losses(spark):
    df = candidates(spark, [("a", "rf", *GOOD)])
    r = gates.wins_losses(df, gates.production_metrics(prod(spark, 0.66, 0.81, 0.76, 0.60))).first()
    assert (r["wins"], r["losses"], r["blocked"]) == (1, 3, True)


def test_promote_and_rollback(spark):
    v = spark.createDataFrame(
        [("rf_m", 1, None, 10.0), ("rf_m", 2, "Production", 20.0), ("gb_m", 1, None, None)],
        "model string, version int, alias string, promoted_at double",
    )
    after = registry.promote(v, F.lit("gb_m"), F.lit(1), F.lit(30.0))
    assert [(r["model"], r["version"]) for r in after.filter("alias = 'Production'").collect()] == [("gb_m", 1)]
    back = registry.rollback(after)
    assert [(r["model"], r["version"]) for r in back.filter("alias = 'Production'").collect()] == [("rf_m", 2)]
    ranks = {(r["model"], r["version"]): r["rank"] for r in registry.promotion_ranks(after).collect()}
    assert ranks == {("gb_m", 1): 0, ("rf_m", 2): 1, ("rf_m", 1): 2}


def test_param_merge_order():
    got = ml.merge_params({"a": 2, "b": 2}, {"b": 3, "n": 9}, {"a": 1, "c": 1}, {"n": -1})
    assert got == {"a": 2, "b": 3, "c": 1, "n": -1}


def test_unlimited_depth_and_leaf_count():
    from sevspark import presets

    assert ml.build("rf", presets.MODEL_PARAMS["rf"]).getMaxDepth() == 30
    p = ml.boosting_params("gbt_leaf", presets.MODEL_PARAMS["gbt_leaf"])
    assert (p.leaves, p.depth, p.rounds, p.min_rows, p.row_share) == (100, None, 650, 12, 0.8)
    p = ml.boosting_params("gbt_depth", {**presets.MODEL_PARAMS["gbt_depth"], "reg_alpha": 2, "gamma": 3})
    assert (p.leaves, p.depth, p.rounds, p.l1, p.l2, p.gamma, p.min_hessian) == (None, 5, 300, 2, 1.0, 3, 1)


def test_score_gives_probability_of_the_predicted_class(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 6).cast("int").alias("y"))
    train = ml.training_frame(df, ["x"], "y")
    model = ml.fit(train, "rf", {"n_estimators": 3, "max_depth": 3})
    out = ml.score(model, df, ["x"])
    rows = out.collect()
    assert all(r["prediction"] in (0, 1) and 0.5 <= r["probability"] <= 1 for r in rows)
    for r in rows:
        assert r["probability"] == pytest.approx(r["severe_probability"] if r["prediction"] else 1 - r["severe_probability"], abs=1e-4)
    assert ml.test_metrics(out, "y").first()["auc"] == pytest.approx(1.0)


def test_scenarios(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 130, 3, 5, 2, 5), (2, 3, 2, 50, 1, 1, 6, 4), (3, 4, 2, 90, 4, 7, 3, 2)],
        "id int, catr int, agg_ int, vma int, lum int, surf int, intersection_type int, catv int",
    )
    n = {k: whatif.matching(df, k).first()["n_rows"] for k in whatif.SCENARIOS}
    assert n == {"motorway_110": 1, "lighting": 2, "zone30": 1, "dry_road": 2, "roundabout": 2, "more_bikes": 1, "more_motos": 1}
    before, after = whatif.apply(df, "motorway_110", ["id"])
    assert before.first()["vma"] == 130 and after.first()["vma"] == 110
    _, more = whatif.apply(df, "more_bikes", ["id"], 3.0)
    assert more.filter("catv = 5").count() == 3 and more.count() == 5

    def predict(d):
        return d.withColumns({"prediction": (F.col("vma") > 100).cast("int"), "severe_probability": F.col("vma") / 200})

    r = whatif.delta(before, after, predict).first()
    assert (r["pct_before"], r["pct_after"], r["verdict"]) == (100.0, 100.0, "no change")
    pair = whatif.pair(df, "id", "vma", 90, 50, predict).first()
    assert pair["delta"] == pytest.approx(0.2)


def test_registered_models_use_the_published_parameters(monkeypatch):
    from types import SimpleNamespace

    import __spark_entry__  # noqa: F401  (registers in order)
    from sevspark.demo import base, learning

    trained, searched = [], []
    frame = SimpleNamespace(persist=lambda: frame)
    monkeypatch.setattr(learning, "split_table", lambda t: frame)
    monkeypatch.setattr(learning, "train_frame", lambda t: frame)
    monkeypatch.setattr(learning.training, "train_and_test", lambda split, algo, **kw: trained.append((algo, kw.get("overrides"))))
    monkeypatch.setattr(ml, "_search", lambda train, points, folds, *rest: searched.append((len(points), folds)) or [])
    for algo in learning.training.ALGORITHMS:
        learning._model.__wrapped__("app", "folder", None, algo)
    assert trained == [(algo, None) for algo in learning.training.ALGORITHMS]
    t = SimpleNamespace(spark=SimpleNamespace(createDataFrame=lambda rows, schema: rows))
    base.QUERIES["ml_grid_search"](t)
    base.QUERIES["ml_random_search"](t)
    assert searched == [(81, 5), (20, 3)]
