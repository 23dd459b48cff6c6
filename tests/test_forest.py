"""Forests against plain recursive trees, both ways of growing, truncated trees, the search against single forests."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sevspark.operators import forest, ml


def data(n=900, columns=5, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, columns)), 1)
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (r.random(n) < 0.15)).astype(int)


def frame(spark, x, y, weights=(1.0, 2.0)):
    rows = [(list(map(float, v)), float(t), float(weights[t])) for v, t in zip(x, y)]
    df = spark.createDataFrame(rows, "v array<double>, label double, weight double").repartition(3)
    return df.select(array_to_vector("v").alias("features"), "label", "weight")


def plain(x, y, w, bins, p, depth=0):
    """Leaf class weights of each row, by trying every cut of every column."""
    total = np.bincount(y, w, 2)
    gini = lambda s: s.sum() - (s * s).sum() / s.sum()
    best = (1e-10, None)
    for c in range(x.shape[1]) if depth < p.depth else ():
        for cut in range(bins[c]):
            left = x[:, c] <= cut
            if min(left.sum(), (~left).sum()) >= p.min_rows:
                gain = (gini(total) - gini(np.bincount(y[left], w[left], 2)) - gini(np.bincount(y[~left], w[~left], 2))) / total.sum()
                if gain > best[0] + 1e-12 and gain >= p.min_gain:
                    best = (gain, left)
    out = np.tile(total, (len(y), 1))
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain(x[side], y[side], w[side], bins, p, depth + 1)
        if len(set(out.argmax(axis=1))) == 1:  # one class below: a leaf
            out = np.tile(total, (len(y), 1))
    return out


@pytest.mark.parametrize("by_class", [np.array([1.0, 2.5]), None])
@pytest.mark.parametrize("given", [{"depth": 4}, {"depth": 30, "min_rows": 7}, {"depth": 6, "min_gain": 0.02}])
def test_a_tree_equals_a_plain_one(by_class, given):
    x, y = data(300, 3)
    edges = [np.unique(x[:, i])[::4].tolist() for i in range(3)]
    x, w = forest.binned(x, edges), np.array([1.0, 2.5])[y]
    p = forest.Params(1, **given)
    shape = forest.Shape(2, np.array([len(e) + 2 for e in edges]), by_class, 3)
    tree = forest.grow(x, y, w, np.ones(len(y)), forest.root_key(1, 0), 0, shape, p).pruned()
    assert np.allclose(tree.stats[tree.route(x)], plain(x, y, w, shape.bins, p))


@pytest.mark.parametrize("weights", [(1.0, 2.0), None])
def test_large_tables_give_the_same_forest(spark, monkeypatch, weights):
    """Rows over the limit of one task: upper nodes by summed histograms, the rest dealt by node, trees in several waves."""
    x, y = data()
    train = frame(spark, x, y, weights or (1.0, 2.0))
    if not weights:
        train = train.withColumn("weight", F.lit(1.1) + F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: F.sin(a + 7 * v)))
    p = forest.Params(5, 30, 2)
    whole = forest.fit(train, p, "weight")
    monkeypatch.setattr(forest, "LOCAL_ROWS", 100)
    monkeypatch.setattr(forest, "WAVE_ROWS", 2 * len(y))
    parts = forest.fit(train, p, "weight")
    assert (len(whole.waves), len(parts.waves), whole.nodes) == (1, 3, parts.nodes)
    assert np.allclose(whole.featureImportances.toArray(), parts.featureImportances.toArray())
    got = [np.array([r["p"] for r in m.score(train, "features", "p").collect()]) for m in (whole, parts)]
    assert np.allclose(*got) and len(np.unique(got[0])) > 50


def test_truncated_trees_are_those_of_less_depth_and_more_gain():
    x, y = data(600, 4)
    edges = [np.unique(x[:, i])[::2].tolist() for i in range(4)]
    x = forest.binned(x, edges)
    shape = forest.Shape(2, np.array([len(e) + 2 for e in edges]), np.ones(2), 2)
    grown = lambda **kw: forest.grow(x, y, np.ones(len(y)), np.ones(len(y)), forest.root_key(3, 1), 0, shape, forest.Params(9, **kw))
    full = grown(depth=30)
    for depth, gain in ((30, 0.0), (3, 0.0), (30, 0.01), (5, 0.02)):
        own = grown(depth=depth, min_gain=gain).pruned()
        end = full.ends(full.stopped(depth, gain))
        assert np.allclose(full.values()[end[full.route(x)]], own.values()[own.route(x)])
    assert full.depth.max() > 8 and len(full.pruned().column) < len(full.column)


@pytest.mark.parametrize("limit", [1 << 18, 150])
def test_search_equals_single_forests(spark, monkeypatch, limit):
    monkeypatch.setattr(forest, "LOCAL_ROWS", limit)
    x, y = data(500)
    train = frame(spark, x, y).coalesce(1).persist()
    points = [{"numTrees": n, "maxDepth": d, "minInfoGain": g, "minInstancesPerNode": m} for n in (1, 3, 7) for d, g in ((30, 0.0), (4, 0.01)) for m in (1, 4)]
    found = dict(ml._search(train, points, 2, 1, 5))
    assert len(found) == len(points)
    lot = F.floor(F.rand(5) * 2).cast("int")
    dealt = train.select("features", "label", lot.alias("fold")).persist()
    for point in (points[0], points[6], points[11]):
        marks = []
        for fold in range(2):
            rows, columns, classes, _, n = forest.prepared(dealt, None, "fold")
            edges = forest.bin_edges(rows.where(F.col("fold") != fold), columns)
            p = forest.Params(point["numTrees"], point["maxDepth"], point["minInstancesPerNode"], point["minInfoGain"], seed=5)
            table = forest.blocks(rows, edges)
            monkeypatch.setattr(forest, "LOCAL_ROWS", 1 << 18)
            grower = forest.Grower(table, edges, p, classes, n, np.ones(2), fold)
            trees = [t.pruned() for wave in grower.waves() for _, t in wave.collect()]
            held = [forest.opened(r, columns) for r in table.select("block", "bins", "label", "weight", "fold").collect()]
            bins, label = (np.concatenate([h[i][h[3] == fold] for h in held]) for i in (0, 1))
            says = sum(t.values()[t.route(bins)] for t in trees).argmax(axis=1)
            tp = int(((says == 1) & (label == 1)).sum())
            marks.append(2 * tp / ((says == 1).sum() + (label == 1).sum()))
        assert found[str(point)] == pytest.approx(np.mean(marks), abs=1e-12)


def test_forest_agrees_with_sparks_and_costs_no_job_by_level(spark):
    """Held-out rows are told as well as by Spark's own forest; unlimited depth takes a few jobs, not some for each level."""
    x, y = data(2400, 6)
    train, test = frame(spark, x[:1600], y[:1600]).persist(), frame(spark, x[1600:], y[1600:])
    given = {"n_estimators": 30, "min_samples_leaf": 5, "max_features": "sqrt", "criterion": "gini", "max_depth": None, "class_weight": "balanced"}
    theirs = ml.build("rf", given, weight="weight").fit(train)
    assert isinstance(theirs, RandomForestClassificationModel)
    told = theirs.transform(test).agg(F.avg(F.expr("double(prediction = label)"))).first()[0]
    group = "forest-jobs"
    spark.sparkContext.setJobGroup(group, group)
    ours = ml.fit(train, "rf", given)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20
    shares = ours.score(test, "features", "p").select("label", F.col("p")[1].alias("p"))
    assert shares.agg(F.avg(F.expr("double(double(p > 0.5) = label)"))).first()[0] > told - 0.03
    assert ours.featureImportances.toArray()[:2].sum() == pytest.approx(theirs.featureImportances.toArray()[:2].sum(), abs=0.1)


def test_odd_tables(spark):
    x, y = data(40)
    one = forest.fit(frame(spark, x, np.zeros(40, int)), forest.Params(3, 30), "weight")
    assert one.nodes == 3 and one.score(frame(spark, x, y), "features", "p").first()["p"] == [1.0, 0.0]
    few = forest.fit(frame(spark, x[:1], y[:1]), forest.Params(8, 30))
    assert few.nodes == 8
    assert forest.fit(frame(spark, np.zeros((40, 2)), y), forest.Params(2, 30)).nodes == 2
    three = spark.range(90).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), F.floor(F.col("id") / 30).cast("double").alias("label"))
    shares = forest.fit(three, forest.Params(9, 5, impurity="entropy")).score(three, "features", "p").collect()
    assert all(len(r["p"]) == 3 and sum(r["p"]) == pytest.approx(1) for r in shares)
    assert np.mean([np.argmax(r["p"]) == r["label"] for r in shares]) > 0.9
    with pytest.raises(ValueError, match="no rows"):
        forest.fit(three.where("false"), forest.Params(2, 5))
    with pytest.raises(ValueError, match="whole numbers"):
        forest.fit(three.withColumn("label", F.lit(0.5)), forest.Params(2, 5))
