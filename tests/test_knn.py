"""The exact nearest-neighbour join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevspark.operators import knn, sampling


def vectors(n: int, dims: int, copies: int = 0):
    r = np.random.default_rng(4)
    centres = r.normal(0, 10, (7, dims))
    x = centres[r.integers(0, 7, n)] + r.normal(0, 1, (n, dims))
    x[-copies:] = x[0] if copies else x[-copies:]
    x[5] = np.round(x[6])  # ties at whole numbers
    return x


def brute(x, keys, y, ids, k, metric):
    d = knn._distances(x, y, metric)
    out = {}
    for i, key in enumerate(keys):
        order = sorted(range(len(y)), key=lambda j: (d[i, j], ids[j]))
        out[key] = [(ids[j], d[i, j]) for j in order if ids[j] != key][:k]
    return out


def table(spark, keys, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(keys, x)], "id long, v array<double>").repartition(3)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["nn_id"], r["dist"]))
    return out


@pytest.mark.parametrize(("chunk", "pivots", "dims"), [(16, 12, 3), (8192, 1024, 8)])
def test_neighbours_of_the_table_itself(spark, monkeypatch, chunk, pivots, dims):
    monkeypatch.setattr(knn, "CHUNK", chunk)
    monkeypatch.setattr(knn, "PIVOTS", pivots)
    x, keys = vectors(260, dims, copies=60), random.Random(1).sample(range(10**6), 260)
    got = knn.nearest_within(table(spark, keys, x), "id", "v", 5).collect()
    at = dict(zip(keys, x))
    assert found(spark.createDataFrame(got)) == brute(x, keys, x, keys, 5, "minkowski")
    assert all(np.array_equal(r["nn_vec"], at[r["nn_id"]]) for r in got)


@pytest.mark.parametrize("metric", knn.METRICS)
def test_neighbours_in_another_table(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "CHUNK", 20)
    x, y = vectors(80, 4, copies=20), vectors(150, 4)[::-1]
    keys, ids = [-1 - i for i in range(80)], list(range(150))
    got = knn.nearest(table(spark, keys, x), "id", "v", table(spark, ids, y), "id", 9, metric)
    assert found(got) == brute(x, keys, y, ids, 9, metric)


def test_few_rows_and_none(spark):
    rows = table(spark, [3, 1], np.array([[0.0, 1.0], [2.0, 1.0]]))
    assert found(knn.nearest_within(rows, "id", "v", 5)) == {1: [(3, 2.0)], 3: [(1, 2.0)]}
    assert found(knn.nearest(rows, "id", "v", rows.where("false"), "id", 5)) == {}
    assert knn.nearest_within(rows.where("false"), "id", "v", 5).count() == 0
    missing = rows.union(rows.select(F.lit(9).cast("long"), F.lit(None).cast("array<double>")))
    assert set(found(knn.nearest_within(missing, "id", "v", 1))) == {1, 3}
    with pytest.raises(ValueError, match="metric"):
        knn.nearest(rows, "id", "v", rows, "id", 1, "cosine")


def test_cells_that_are_left_out_hold_no_neighbour(spark):
    """Clustered rows: most pairs of a query and a cell are never searched."""
    x = vectors(400, 6)
    cells = knn.Cells(x[:20], "minkowski")
    away = knn._distances(x, cells.pivots, "minkowski")
    own = away.argmin(axis=1)
    cells.fill([{"cell": c, "low": away[own == c, c].min(), "high": away[own == c, c].max(), "n": int((own == c).sum())} for c in set(own)])
    d = knn._distances(x, x, "minkowski")
    bound = np.sort(d, axis=1)[:, 6]
    reach = cells.reachable(away, bound)
    assert all(reach[i, own[j]] for i in range(400) for j in np.flatnonzero(d[i] <= bound[i]))
    assert reach.mean() < 0.5


def test_votes(spark):
    x = np.array([[0.0], [1.0], [2.0], [10.0], [11.0]])
    sample = table(spark, range(5), x).withColumn("y", (F.col("id") > 2).cast("int"))
    rows = table(spark, [100, 101], np.array([[0.4], [9.0]]))
    got = {(r["id"], r["metric"], r["k"]): r["pred"] for r in knn.vote(rows, "id", "v", sample, "y", ks=[1, 2, 5]).collect()}
    assert got == {(i, m, k): int(i == 101 and k < 5) for i in (100, 101) for m in knn.METRICS for k in (1, 2, 5)}


def test_smote_lies_between_neighbours(spark):
    x = vectors(60, 2)
    rows = table(spark, range(60), x).withColumn("y", (F.col("id") < 20).cast("int"))
    new = sampling.smote(rows, "v", "y", "id", 3).collect()
    assert len(new) == 20 and {r["y"] for r in new} == {1}
    for r in new:
        a, b, v = x[r["base"]], x[r["nn_id"]], np.array(r["v"])
        assert r["nn_id"] != r["base"] and np.linalg.norm(v - a) + np.linalg.norm(b - v) == pytest.approx(np.linalg.norm(b - a))
