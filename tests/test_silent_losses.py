"""Losses that once went unnoticed: repeated batch numbers, whole doubles, rollback after a manual promotion."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevspark.operators import registry, validate
from sevspark.plans import replay
from sevspark.session import shared_dir
from sevspark.sources import catalog, sinks, tables
from sevspark.streaming import alerts


def test_two_replays_keep_all_rows_and_a_retry_replaces(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit(1.0).alias("x"))
    predict = lambda df: df.withColumn("probability", F.lit(0.5))
    for writer in (None, None, "job", "job"):
        replay.replay(rows, ["id"], {"x": "double"}, predict, str(tmp_path), "v1", writer=writer)
    assert sinks.read_predictions(spark, str(tmp_path)).count() == 30


def test_whole_doubles_are_whole_numbers(spark):
    df = spark.createDataFrame([(12.0,), (3.0,), (None,)], "a double")
    assert validate.coerce(df, {"a": ("int", None)})[1] == 0
    odd = spark.createDataFrame([(12.5,), (1e12,), (float("nan"),), (2.0,)], "a double")
    assert validate.coerce(odd, {"a": ("int", None)})[1] == 3


def test_rollback_goes_to_the_saved_version(spark):
    v = spark.createDataFrame(
        [("m", 1, None, "2024-01-01"), ("m", 2, None, "2024-01-02"), ("m", 3, "x", "2024-01-03")], "model string, version int, alias string, promoted_at string"
    )
    v = v.withColumn("promoted_at", F.col("promoted_at").cast("timestamp")).withColumn("alias", F.when(F.col("alias").isNotNull(), registry.LIVE))
    assert registry.live_version(v) == ("m", 3)
    back = registry.rollback(v, ("m", 1))
    assert registry.live_version(back) == ("m", 1)
    # a second rollback, to what was saved before another promotion
    assert registry.live_version(registry.rollback(back, ("m", 2))) == ("m", 2)


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(type(context), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(context, "master", "spark://somewhere:7077")
    if not context.getConf().get("spark.checkpoint.dir"):
        with pytest.raises(RuntimeError):
            shared_dir(spark)


def test_late_accents_and_other_column_order(spark, tmp_path):
    many = "Num_Acc;adr\n" + "".join(f"{i};x\n" for i in range(50))
    (tmp_path / "a.csv").write_bytes((many + "50;allée\n").encode("latin-1"))
    (tmp_path / "b [1].csv").write_bytes("adr;vma;Num_Acc\nrue é;90;51\n".encode())
    (tmp_path / "c.csv").write_bytes("﻿Num_Acc,vma\n52,80\n".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = tables.read_csv(spark, str(tmp_path))
    got = {r["Num_Acc"]: (r["adr"], r["vma"]) for r in rows.collect()}
    assert len(got) == 53 and got["50"] == ("allée", None) and got["51"] == ("rue é", "90") and got["52"] == (None, "80")
    typed = tables.read_csv(spark, str(tmp_path), T.StructType.fromDDL("vma int, Num_Acc string, lum int"))
    assert typed.dtypes == [("vma", "int"), ("Num_Acc", "string"), ("lum", "int")]
    assert {tuple(r) for r in typed.where("vma is not null").collect()} == {(90, "51", None), (80, "52", None)}
    (tmp_path / "d.csv").write_text("one\n1\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path))


def test_missing_values_of_required_columns(spark):
    df = spark.createDataFrame([(None, "1"), (5, None)], "jour int, dep string")
    found = {r["check"]: r["detail"] for r in validate.schema_messages(df, "caracteristiques").collect()}
    assert found["type_check"] == "nullable:jour=1, nullable:dep=1"
    assert validate.coerce(df, {"jour": ("string", None)}, ["jour"])[1] == 1
    assert validate.coerce(df, {"jour": ("string", None)})[1] == 0


def test_a_runner_up_file_serves_the_next_category(spark):
    rows = [("f", "vehiculs-2021"), ("f", "usagrs-2021"), ("f", "vehicls"), (None, "lieu"), (None, "lieu")]
    df = spark.createDataFrame(rows, "folder string, file string")
    both = {"vehicules": ["zzz"], "vehiculs": ["zzz"], "usagers": ["zzz"], "lieux": ["zzz"]}
    got = {(r["folder"], r["category"]): r["file"] for r in catalog.match_files(df, ["folder"], "file", both).collect()}
    assert got == {("f", "vehicules"): "vehiculs-2021", ("f", "vehiculs"): "vehicls", ("f", "usagers"): "usagrs-2021", (None, "lieux"): "lieu"}


def test_alerts_go_on_only_with_their_state(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as ts, 1 as k, true as breach from range(3)").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, k int, breach boolean").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        alerts.run_alerts(stream(), "ts", ["k"], [], 60, 60, checkpoint=str(tmp_path / "c"))
    where = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "c")}
    assert alerts.run_alerts(stream(), "ts", ["k"], [], 60, 60, **where).count() == 1
    more = "select timestamp'2024-01-01 00:03:00' as ts, 2 as k, true as breach"
    spark.sql(more).write.mode("append").parquet(str(tmp_path / "in"))
    assert alerts.run_alerts(stream(), "ts", ["k"], [], 60, 60, **where).count() == 1
    spark.sql(more).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        alerts.run_alerts(stream(), "ts", ["k"], [], 60, 60, path=str(tmp_path / "new"), checkpoint=where["checkpoint"])
