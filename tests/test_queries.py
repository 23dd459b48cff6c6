"""Registered queries against their SQL counterparts; SEVSPARK_ALL_QUERIES=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sevspark.demo.base import TABLES
from tools.check import canon

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "geo_hotspots", "feat_engineer", "impute_mode_train", "rank_most_severe", "agg_mode", "agg_corr_matrix", "join_counts",
    "eval_auc", "drift_wasserstein", "drift_chi2", "drift_summary", "log_parse_logfmt", "log_count_window", "met_rate",
    "met_latency_quantiles", "met_state_timeline", "alert_for_duration", "gate_champion", "eval_compare", "reg_table",
    "rank_keep_newest", "val_report", "val_payload", "src_resolve_catalog", "src_match_files", "split_random",
    "sample_replicate", "sample_smote", "ml_knn", "whatif_zone30", "stream_sessions",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("SEVSPARK_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry_has_rows(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert entry.entry(spark).columns == ["lat_r", "lon_r", "n", "pct", "n_cells"]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
