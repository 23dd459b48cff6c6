import pytest
from pyspark.sql import functions as F

from sevspark.operators import alerts as batch_alerts
from sevspark.streaming import alerts, runner, scoring, windows


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)


SCHEMA = "host string, id long, t long, breach boolean"


def test_alert_state_survives_between_batches(spark, tmp_path):
    src, base, offsets = (str(tmp_path / n) for n in ("src", "out", "offsets"))
    rows = [("a", i, 6000 + i * 60, i not in (7, 8)) for i in range(16)] + [("b", 100 + i, 6000 + i * 60, i >= 14) for i in range(16)]
    rows += [("c", 200 + i, 6000 + i * 60, True) for i in range(16) if i not in (5, 10)]  # samples that stay away end a breach
    for part in range(5):
        batch = [r for r in rows if part * 4 <= r[2] // 60 - 100 < part * 4 + 4]
        # out of order, and in the end a sample that moves the watermark on and one that comes too late
        write(spark, src, batch[::-1] if part < 4 else [("end", 0, 16_000, False), ("b", 1, 6060, True)], SCHEMA)
        stream = runner.read_files(spark, src, "*.parquet")
        fired = alerts.run_alerts(stream, "ts", ["host"], "id", 60, 300, 60, path=base, checkpoint=offsets)
    got = sorted((r["host"], r["start_s"], r["fired_s"]) for r in fired.collect())
    steps = spark.createDataFrame(rows, SCHEMA).withColumns({"ts": F.timestamp_seconds("t"), "for_s": F.lit(300)})
    want = sorted(
        (r["host"], r["start_s"], r["fired_s"]) for r in batch_alerts.firing(steps, "ts", 60, ["host"]).collect()
    )
    assert got == want == [("a", 6000, 6300), ("a", 6540, 6840)]
    assert not [x for x in (tmp_path / "out").iterdir() if x.is_dir() and x.name != "_spark_metadata"]


def feed(samples, step_s, for_s, no_data):
    """Alerts of one series, its state handed on as plain values before each sample."""
    state, fired = None, []
    for t, broken in samples:
        breach = alerts.Breach(step_s, for_s, no_data, state)
        fired += breach.sample(t, broken)
        state = breach.state()
    return fired


def test_rules_for_missing_data():
    gap = [(0, True), (60, True), (600, True), (660, False)]
    assert feed(gap, 60, 300, "ends") == [] and feed(gap, 60, 300, "holds") == [(0, 300)] and feed(gap, 60, 300, "fires") == [(0, 300)]
    assert feed([(0, True), (400, False)], 60, 300, "fires") == [(0, 300)] and feed([(0, True), (400, False)], 60, 300, "holds") == []
    assert feed([(t, True) for t in range(0, 1000, 60)], 60, 300, "ends") == [(0, 300)]


def test_upserts_keep_the_newest_row_of_a_key_through_merges_and_retries(spark, tmp_path):
    table = runner.Upserts(spark, str(tmp_path / "t"), "k long, n long", ["k"], merge_every=3)
    assert table.read().count() == 0
    for i in range(8):
        for _ in range(1 + (i in (3, 6))):  # a batch that is repeated
            table.write(spark.createDataFrame([(i, i), (i + 1, i), (None, i)], "k long, n long"), i)
    got = {r["k"]: r["n"] for r in table.read().collect()}
    assert got == {**{i: i for i in range(8)}, 8: 7, None: 7}
    assert sorted(x.name for x in (tmp_path / "t/changes").iterdir() if x.is_dir()) == ["part=6", "part=7"]


def test_windows_in_update_mode_drop_late_rows_and_survive_a_restart(spark, tmp_path):
    src, path, offsets = (str(tmp_path / n) for n in ("src", "out", "offsets"))
    for hour in range(4):
        write(spark, src, [("a", i, hour * 3600 + i * 60, True) for i in range(30)], SCHEMA)
        if hour == 3:
            write(spark, src, [("a", 99, 30, True)], SCHEMA)
        stream = runner.read_files(spark, src, "*.parquet", files_per_batch=1)
        counts = windows.tumbling_counts(stream, "ts", ["host"], "10 minutes", "1 minute")
        out = runner.upsert_to(counts, path, ["host", "start"], offsets, merge_every=2)
    rows = out.collect()
    assert len(rows) == 12 and {r["n"] for r in rows} == {10}


def test_slices_follow_time(spark):
    df = spark.range(1000).select("id", F.timestamp_seconds(F.when(F.col("id") > 5, F.col("id") * 7 % 1000)).alias("ts"))
    parts = runner.time_slices(df, "ts", 4)
    bounds = [p.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).first() for p in parts]
    assert sum(b["n"] for b in bounds) == 1000 and all(150 < b["n"] < 350 for b in bounds)
    assert all(a["high"] < b["low"] for a, b in zip(bounds, bounds[1:]))


def test_duplicates_are_dropped_across_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    for _ in range(2):
        write(spark, src, [("a", i, 100_000 + i, True) for i in range(20)], SCHEMA)
    stream = runner.read_files(spark, src, "*.parquet", files_per_batch=1)
    assert runner.to_table(windows.deduplicated(stream, "ts", ["id"], "1 hour"), "t").count() == 20


def test_append_windows_close_with_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    write(spark, src, [("a", i, i * 60, True) for i in range(30)], SCHEMA)
    counts = windows.tumbling_counts(runner.read_files(spark, src, "*.parquet"), "ts", ["host"], "10 minutes", "1 minute")
    assert runner.to_table(counts, "c", "complete").count() == 3


def test_scoring_sets_bad_requests_aside(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, '{"vma": %s}' % ('"x"' if i % 5 == 0 else i)) for i in range(50)]
    spark.createDataFrame(rows, "id long, body string").repartition(4).write.parquet(src)
    stream = runner.read_files(spark, src, "*.parquet", ts=None, files_per_batch=1)

    def predict(df):
        return df.withColumns({"prediction": (F.col("vma") > 25).cast("int"), "probability": F.lit(0.123456)})

    good, bad = scoring.score_requests(stream, ["id"], "body", {"vma": "int"}, predict, "m:v1", str(tmp_path / "out"))
    log = spark.read.parquet(good)
    assert log.count() == 40 and spark.read.parquet(bad).count() == 10
    assert log.select("model_version", "probability").distinct().collect() == [("m:v1", 0.1235)]
    assert log.select("batch_id").distinct().count() == 4
