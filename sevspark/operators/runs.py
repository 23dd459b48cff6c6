"""Tables of job runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import when
from . import rank

# --- fixed values ---
STATE_LABELS = {"COMPLETED": "🟢 OK", "FAILED": "🔴 Échec", "CRASHED": "🔴 Crash", "CANCELLED": "⏹ STOP"}
TRIGGER_TEXT = {"T1": "new data", "T2": "code", "T3": "new parameters"}
# --- end of fixed values ---


def trigger_code(champion: Column, year: Column, sha_tag: Column) -> Column:
    """T3 with champion, year and code; T1 with champion and year; else T2."""
    data = F.coalesce(champion != "", F.lit(False)) & year.isNotNull()
    code = F.coalesce(sha_tag != "", F.lit(False))
    return F.when(data & code, F.lit("T3")).when(data, F.lit("T1")).otherwise(F.lit("T2"))


def lookup(c: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[c], c if default is None else default)


def recent(runs: DataFrame, ts: str, run_id: str, n: int) -> DataFrame:
    return rank.top_groups(runs, [F.col(ts).desc(), F.col(run_id).desc()], n)


def run_table(runs: DataFrame, names: Mapping[str, str], zone: str) -> DataFrame:
    """Readable name, state, local start and duration of every run."""
    return runs.select(
        "run_id", lookup(F.col("flow"), names).alias("flow"), F.coalesce("state", F.lit("?")).alias("state"),
        when.local_minute(F.col("start_time"), zone).alias("started"),
        when.seconds_text(F.col("seconds")).alias("duration"),
    )


def deployments(runs: DataFrame, flows: list[str], zone: str) -> DataFrame:
    """Finished deployment runs with trigger and state label."""
    done = runs.filter(F.col("flow").isin(flows) & F.col("state").isin(list(STATE_LABELS)))
    code = trigger_code(F.col("champion"), F.col("year"), F.col("sha_tag"))
    return done.select(
        "run_id", code.alias("trigger"), lookup(code, TRIGGER_TEXT).alias("description"),
        when.local_minute(F.col("start_time"), zone).alias("started"),
        lookup(F.col("state"), STATE_LABELS).alias("status"),
    )
