"""Alert rules over windowed metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


@dataclass(frozen=True)
class Rule:
    """``metric op limit`` must hold for ``for_s`` seconds before the rule fires."""

    name: str
    metric: str
    op: str
    limit: float
    for_s: int = 60


# --- fixed values ---
DEFAULT_RULES = [
    Rule("brute_force_401", "increase_401_5m", "gt", 20, 60),
    Rule("rate_limit_429", "increase_429_5m", "gt", 50, 60),
    Rule("memory_low", "free_memory_pct", "lt", 10, 120),
    Rule("disk_low", "free_disk_pct", "lt", 15, 120),
    Rule("error_logs", "log_count", "gt", 0, 0),
    Rule("replicas_low", "replicas_available", "lt", 2, 120),
    Rule("probe_down", "probe_success", "lt", 1, 60),
]
# --- end of fixed values ---


def evaluate(metrics: DataFrame, rules: Sequence[Rule], metric: str = "metric", value: str = "value") -> DataFrame:
    """One row per sample and rule on its metric, with ``breach``; missing values do not breach."""
    hits = []
    for r in rules:
        v = F.col(value)
        broken = v > r.limit if r.op == "gt" else v < r.limit
        item = F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.for_s).alias("for_s"), F.coalesce(broken, F.lit(False)).alias("breach")
        )
        hits.append(F.when(F.col(metric) == r.metric, item))
    return metrics.withColumn("_r", F.explode(F.array_compact(F.array(*hits)))).select(*metrics.columns, "_r.*")


def firing(steps: DataFrame, ts: str, step_s: int, keys: Sequence[str] = ("rule",), unique: bool = False) -> DataFrame:
    """Breaches that lasted: one row per unbroken breach with start, time of firing and end.

    A missing evaluation step counts as no breach, so a gap longer than ``step_s`` ends a run. ``unique``: no two steps of a
    series share a second, as after a windowed aggregate; the rows are then written once less.
    """
    keys = list(keys)
    seconds = steps.withColumn("_t", F.unix_timestamp(F.col(ts).cast("timestamp")))
    o = Ordered(seconds, keys, ["_t"], unique=unique).previous({"_pt": "_t", "_pb": "breach"})
    goes_on = F.coalesce(F.col("_pb") & (F.col("_t") - F.col("_pt") <= step_s), F.lit(False))
    o = o.running_sum({"_run": (F.col("breach") & ~goes_on).cast("bigint")})
    runs = o.rows().filter("breach").groupBy(*keys, "for_s", "_run").agg(
        F.min("_t").alias("start_s"), F.max("_t").alias("end_s"), F.count(F.lit(1)).alias("steps")
    )
    return runs.filter(F.col("end_s") - F.col("start_s") >= F.col("for_s")).select(
        *keys, "start_s", (F.col("start_s") + F.col("for_s")).alias("fired_s"), "end_s", "steps"
    )
