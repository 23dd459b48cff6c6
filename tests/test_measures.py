import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sevspark.functions import hashing
from sevspark.operators import aggregate, alerts, drift, evaluate, intervals, knn, metrics, ordered, rank, sampling


def skewed(spark, n=600, seed=1):
    """One series holds a third of the rows, the rest spread over many."""
    rnd = random.Random(seed)
    rows = [
        ("hot" if rnd.random() < 0.34 else f"s{rnd.randrange(40)}", i, rnd.randrange(3), float(rnd.randrange(50)))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "series string, t long, state int, v double")


def test_ordered_matches_brute_force(spark):
    rows, df = skewed(spark)
    o = ordered.Ordered(df, ["series"], ["t"], blocks=7).previous({"pv": "v"}).running_sum({"cum": "v"})
    got = {r["t"]: (r["pv"], r["cum"]) for r in o.rows().collect()}
    last, cum = {}, {}
    for s, t, _, v in sorted(rows, key=lambda r: (r[0], r[1])):
        cum[s] = cum.get(s, 0.0) + v
        assert got[t] == (last.get(s), cum[s])
        last[s] = v


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 5)), min_size=1, max_size=40))
def test_prefix_sum_property(spark, values):
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(values)], "i int, s int, v int")
    got = {r["i"]: r["c"] for r in ordered.prefix_sum(df, ["i"], {"c": "v"}, ["s"]).collect()}
    run = {}
    for i, (s, v) in enumerate(values):
        run[s] = run.get(s, 0) + v
        assert got[i] == run[s]


def test_copies_of_one_row_spread_over_blocks(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 300 + [("b", i, 1) for i in range(300)], "s string, t int, v int")
    o = ordered.Ordered(df.repartition(4), ["s"], ["t"], blocks=6).running_sum({"c": "v"})
    sizes = [r["count"] for r in o.df.groupBy(ordered.BLOCK).count().collect()]
    assert max(sizes) < 200
    assert sorted(r["c"] for r in o.rows().filter("s = 'a'").collect()) == list(range(1, 301))


def test_samples_have_exactly_n_rows(spark):
    rows = spark.range(500)
    got = sorted(r["id"] for r in sampling.sample_n(rows, ["id"], 60).collect())
    draws = rows.select("id", hashing.hash_int(["id"], 42).alias("d")).orderBy("d").limit(60).collect()
    assert got == sorted(r["id"] for r in draws)
    assert sampling.sample_n(spark.range(50), ["id"], 60).count() == 50
    # keys that many rows share, and rows that are the same in all columns
    ties = spark.range(3000).selectExpr("id % 10 as k", "id % 100 as v")
    assert sampling.sample_n(ties, ["k"], 777).count() == 777


def test_row_index_is_dense(spark):
    got = ordered.row_index(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000), ["k"]).collect()
    assert all(r["idx"] == r["k"] + 1 for r in got)


def test_islands_and_interruptions(spark):
    rows, df = skewed(spark)
    got = {(r["series"], r["t"]): r["island"] for r in ordered.islands(df, ["series"], ["t"], "state").collect()}
    prev, num = {}, {}
    for s, t, state, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if prev.get(s) != state:
            num[s] = num.get(s, 0) + 1
        prev[s] = state
        assert got[(s, t)] == num[s]


def test_auc_with_ties(spark):
    rnd = random.Random(3)
    pts = [(rnd.randrange(2), rnd.randrange(8) / 8) for _ in range(300)]
    got = evaluate.auc(spark.createDataFrame(pts, "y int, s double"), "y", "s").first()["auc"]
    pos, neg = [s for y, s in pts if y], [s for y, s in pts if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_metrics_of_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    assert evaluate.metrics(evaluate.confusion(df, "y", "p")).first() == (1.0, 0.0, 0.0)


def test_drift_statistics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 20, 400).astype(float), rng.integers(3, 25, 300).astype(float)
    df = spark.createDataFrame([(float(x), False) for x in a] + [(float(x), True) for x in b], "x double, cur boolean")
    counts = drift.side_counts(df, ["x"], F.col("cur"))
    r = drift.distances(counts).first()
    grid = np.arange(0, 26)
    fa, fb = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    assert r["wasserstein"] == pytest.approx(np.abs(fa - fb)[:-1].sum())
    assert r["ks"] == pytest.approx(np.abs(fa - fb).max())
    assert r["std_ref"] == pytest.approx(a.std())


@pytest.mark.parametrize("chi2, dof, p", [(3.841459, 1, 0.05), (18.307, 10, 0.05), (2.0, 5, 0.8491), (124.342, 100, 0.05), (1043.5, 950, 0.018), (100000.0, 100000, 0.49941), (30.0, 1000, 1.0), (80.0, 2, 4.2484e-18)])
def test_chi_square_tail(spark, chi2, dof, p):
    got = spark.range(1).select(drift.chi2_p_value(F.lit(chi2), F.lit(dof))).first()[0]
    assert got == pytest.approx(p, abs=2e-3)


def test_drift_tests_by_size_and_level(spark):
    small = spark.createDataFrame([(float(i % 5), i >= 100) for i in range(200)], "x double, cur boolean")
    num = drift.distances(drift.side_counts(small, ["x"], F.col("cur")))
    cat = drift.divergences(drift.side_counts(small.withColumnRenamed("x", "c"), ["c"], F.col("cur")))
    flags = drift.column_flags(num, cat)
    assert {r["test"] for r in flags.collect()} == {"ks", "chisquare"}
    assert not any(r["drifted"] for r in flags.collect())
    s = drift.summary(flags).first()
    assert (s["drifted_count"], s["total_features"], s["level"]) == (0, 2, "OK")
    for share, level in ((0.26, "CRITICAL"), (0.25, "WARNING"), (0.1, "OK")):
        assert spark.range(1).select(drift.level_of(F.lit(share))).first()[0] == level


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(2, None), (1, 5), (2, 5), (1, 6), (None, 6)], "a int, b int")
    assert {r["feature"]: r["value"] for r in aggregate.modes(df, ["a", "b"]).collect()} == {"a": 1.0, "b": 5.0}


def test_counter_reset_and_quantile(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 4.0, 2.0, 2.0, 7.0])], "s string, t int, v double")
    r = metrics.counter_increase(df, "s", ["t"], "v").first()
    assert (r["increase"], r["resets"]) == (10.0, 1)
    h = metrics.histogram(spark.createDataFrame([("e", v) for v in (0.02, 0.03, 0.2, 9.0)], "e string, v double"), "v", ["e"])
    q = metrics.latency_quantiles(h, ["e"]).first()
    assert q["p50"] == pytest.approx(0.05) and q["p99"] == 5.0


def test_breach_must_last_without_gaps(spark):
    times = [0, 60, 120, 180, 600, 660, 1000]
    df = spark.createDataFrame([("m", t, 5.0) for t in times], "metric string, t long, value double").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    rule = alerts.Rule("r", "m", "gt", 1, 120)
    got = alerts.firing(alerts.evaluate(df, [rule]), "ts", 60).collect()
    assert [(r["start_s"], r["fired_s"], r["end_s"]) for r in got] == [(0, 120, 180)]


def test_start_end_pairs(spark):
    df = spark.createDataFrame(
        [("a", 1, "end"), ("a", 2, "start"), ("a", 5, "end"), ("a", 6, "end"), ("b", 1, "start"), ("b", 4, "start"), ("b", 9, "end")],
        "s string, t long, e string",
    ).withColumn("ts", F.timestamp_seconds("t"))
    got = intervals.pair_start_end(df, ["s"], "ts", ["t"], "e", "start", "end").collect()
    assert {(r["s"], r["duration_s"]) for r in got} == {("a", 3.0), ("b", 5.0)}


def test_exact_split_and_replication(spark):
    df = spark.range(1001).withColumn("catv", (F.col("id") % 3).cast("int"))
    split = sampling.split_random(df, ["id"], 0.3)
    assert split.filter("split = 'test'").count() == 301
    again = sampling.split_random(df.repartition(9), ["id"], 0.3)
    assert again.exceptAll(split).count() == 0
    assert sampling.replicate(df, F.col("catv") == 1, 2.5, ["id"]).count() == 1001 + int(334 * 1.5)
    assert sampling.replicate(df, F.col("catv") == 1, 0.5, ["id"]).count() == 1001
    assert sorted(r["count"] for r in sampling.oversample(df, "catv", ["id"]).groupBy("catv").count().collect()) == [334] * 3
    assert sampling.sample_n(df, ["id"], 10).count() == 10


def test_neighbours_and_votes_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4))
    x[10:20] = x[9]  # a group of copies
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, x array<double>, y int")
    got = knn.nearest_within(df, "id", "x", 5).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(50):
        want = sorted(range(50), key=lambda j: (d[i, j], j))[:5]
        assert [r["nn_id"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == want
    votes = knn.vote(df, "id", "x", df, "y", ks=[1], metrics=["minkowski"]).collect()
    assert sum(v["pred"] == v["id"] % 3 for v in votes) >= 40
    new = sampling.smote(df.filter("id < 40 OR y = 0"), "x", "y", "id", 3)
    assert new.count() > 0 and all(len(r["x"]) == 4 for r in new.collect())




def test_tail_hides_noise_and_counts(spark):
    df = spark.createDataFrame(
        [("r", i, 10 if i % 5 == 0 else 20, f"line {i}" if i % 2 else "Created task run") for i in range(40)],
        "run string, t int, level int, msg string",
    )
    got = rank.tail_with_hidden(df, "run", ["t"], "level", "msg", ["Created task run"], 5).orderBy("rank").collect()
    assert [r["t"] for r in got] == [39, 37, 33, 31, 29] and {r["hidden"] for r in got} == {11}
