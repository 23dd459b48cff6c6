"""Boosted trees on histograms against a brute-force tree, the regularised gain, and held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevspark.operators import boosting, ml


def data(n=400, columns=3, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, columns)), 1)
    x[r.random((n, columns)) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + 0.3 * r.normal(size=n) > 0).astype(float)
    return x, y


def frame(spark, x, y):
    rows = [([None if np.isnan(v) else float(v) for v in row], float(t), float(1 + t)) for row, t in zip(x, y)]
    return spark.createDataFrame(rows, "values array<double>, label double, weight double").repartition(3)


def plain_tree(bins, g, h, p):
    """Best-first growth over all rows at once: ``(value of each row, number of leaves)``."""

    def weigh(rows):
        return np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - p.l1, 0), h[rows].sum() + p.l2

    def best(rows):
        found = (0.0, None, None)
        for c in range(bins.shape[1]):
            for cut in range(boosting.BINS):
                left, right = rows[bins[rows, c] <= cut], rows[bins[rows, c] > cut]
                if min(len(left), len(right)) < max(1, p.min_rows) or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                    continue
                gain = 0.5 * sum(s * weigh(side)[0] ** 2 / weigh(side)[1] for s, side in ((1, left), (1, right), (-1, rows))) - p.gamma
                if gain > found[0] + 1e-9:
                    found = (gain, left, right)
        return found

    leaves = [(np.arange(len(g)), 0)]
    while len(leaves) < (p.leaves or 2**p.depth):
        gains = [best(rows) if p.depth is None or depth < p.depth else (0.0, None, None) for rows, depth in leaves]
        i = int(np.argmax([x[0] for x in gains]))
        if gains[i][0] <= 1e-12:
            break
        depth = leaves.pop(i)[1] + 1
        leaves += [(gains[i][1], depth), (gains[i][2], depth)]
    out = np.zeros(len(g))
    for rows, _ in leaves:
        out[rows] = -weigh(rows)[0] / weigh(rows)[1] * p.rate
    return out, len(leaves)


@pytest.mark.parametrize("given", [
    {"leaves": 7, "min_rows": 5}, {"depth": 3, "l2": 1.0, "min_hessian": 1.0}, {"leaves": 12, "l1": 0.5, "l2": 2.0, "gamma": 0.2}, {"leaves": 9, "depth": 3},
])
def test_trees_equal_plain_best_first_growth(spark, monkeypatch, given):
    monkeypatch.setattr(boosting, "BINS", 30)
    x, y = data()
    p = boosting.Params(rounds=2, rate=0.3, **given)
    model = boosting.fit(frame(spark, x, y), p, "weight")
    bins, w = boosting.binned(x, model.edges), 1 + y
    margins = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for tree in model.trees:
        prob = 1 / (1 + np.exp(-margins))
        want, leaves = plain_tree(bins, w * (prob - y), w * prob * (1 - prob), p)
        got = np.array(tree.value)[tree.route(bins)]
        assert tree.leaves == leaves and np.allclose(got, want, atol=1e-9)
        margins += want
    assert model.gains.sum() > 0


def test_regularisation_shrinks_and_stops(spark):
    x, y = data()
    rows = frame(spark, x, y)
    size = lambda **kw: sum(abs(v) for t in boosting.fit(rows, boosting.Params(rounds=1, depth=2, **kw)).trees for v in t.value)
    assert size(l2=50.0) < size() and size(l1=20.0) < size()
    assert boosting.fit(rows, boosting.Params(rounds=1, depth=2, gamma=1e9)).trees[0].leaves == 1


def test_held_out_rows_and_worker_state(spark, monkeypatch):
    """More trees than one broadcast holds; margins kept in workers and margins made anew agree."""
    monkeypatch.setattr(boosting, "CHUNK", 4)
    x, y = data(1200)
    p = boosting.Params(rounds=11, rate=0.3, leaves=8, min_rows=5, row_share=0.8, column_share=0.7)
    train = frame(spark, x[:800], y[:800])
    model = boosting.fit(train, p)
    assert len(model.trees) == 11
    monkeypatch.setattr(boosting, "CHUNK", 32)
    again = boosting.fit(train, p)
    assert all(np.allclose(a.value, b.value) and (a.column == b.column).all() for a, b in zip(model.trees, again.trees))
    prob = 1 / (1 + np.exp(-boosting.grown(np.full(400, model.base), boosting.binned(x[800:], model.edges), model.trees)))
    assert ((prob > 0.5) == y[800:]).mean() > 0.75
    test = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(np.nan_to_num(x[800:], nan=9.0), y[800:])], "a double, b double, c double, y int")
    scored = ml.score(model, test.withColumns({k: F.when(F.col(k) != 9.0, F.col(k)) for k in "abc"}), ["a", "b", "c"])
    got = np.sort([r["severe_probability"] for r in scored.collect()])
    assert np.allclose(got, np.sort(prob)) and scored.where("probability < 0.5").count() == 0
    assert ml.test_metrics(scored, "y").first()["accuracy"] > 0.75
    assert dict(model.importances(["a", "b", "c"]))["c"] < 0.3


def test_odd_tables(spark):
    x, y = data(60)
    one = boosting.fit(frame(spark, x, np.zeros(60)), boosting.Params(rounds=2, leaves=4))
    assert all(t.leaves == 1 for t in one.trees)
    empty = np.full((60, 3), np.nan)
    assert boosting.fit(frame(spark, empty, y), boosting.Params(rounds=1, leaves=4)).trees[0].leaves == 1
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(frame(spark, x, y).where("false"), boosting.Params(leaves=4))
    with pytest.raises(ValueError, match="leaves"):
        boosting.fit(frame(spark, x, y), boosting.Params())
