"""What-if scenarios: change a feature on the matching rows and compare predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling


@dataclass(frozen=True)
class Scenario:
    """Rows concerned and their edits; ``copies`` instead replicates them inside the whole table."""

    label: str
    concerns: Callable[[], Column]
    edits: dict[str, int] = field(default_factory=dict)
    copies: bool = False


# --- fixed values ---
SCENARIOS = {
    "motorway_110": Scenario(
        "motorway limit 110", lambda: (F.col("catr") == 1) & (F.col("agg_") == 1) & (F.col("vma") >= 120), {"vma": 110}
    ),
    "lighting": Scenario("lit roads at night", lambda: F.col("lum").isin(3, 4), {"lum": 5}),
    "zone30": Scenario("30 in town", lambda: (F.col("agg_") == 2) & F.col("vma").between(45, 55), {"vma": 30}),
    "dry_road": Scenario("no snow or ice", lambda: F.col("surf").isin(5, 7), {"surf": 1}),
    "roundabout": Scenario("roundabouts", lambda: F.col("intersection_type").isin(2, 3), {"intersection_type": 6}),
    "more_bikes": Scenario("more bikes", lambda: F.col("catv") == 5, copies=True),
    "more_motos": Scenario("more motorcycles", lambda: F.col("catv") == 4, copies=True),
}
# --- end of fixed values ---


def apply(
    df: DataFrame, name: str, keys: Sequence[str], multiplier: float = 1.0, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Rows before and after. Edits keep the matching rows only; copies keep the whole table."""
    s = SCENARIOS[name]
    if s.copies:
        return df, sampling.replicate(df, s.concerns(), multiplier, keys, seed)
    before = df.filter(s.concerns())
    types = dict(df.dtypes)
    return before, before.withColumns({c: F.lit(v).cast(types[c]) for c, v in s.edits.items()})


def matching(df: DataFrame, name: str) -> DataFrame:
    """How many rows a scenario concerns."""
    return df.agg(F.count_if(SCENARIOS[name].concerns()).alias("n_rows"))


def delta(before: DataFrame, after: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Percentage predicted severe before and after, difference and verdict; both sides scored in one pass."""
    both = before.withColumn("_side", F.lit("before")).unionByName(after.withColumn("_side", F.lit("after")))
    scored = predict(both)

    def pct(side: str) -> Column:
        return F.avg(F.when(F.col("_side") == side, F.col("prediction").cast("double"))) * 100

    change = F.col("pct_after") - F.col("pct_before")
    verdict = (
        F.when(F.col("n_before") == 0, F.lit("no matching rows"))
        .when(change < 0, F.lit("fewer severe")).when(change > 0, F.lit("more severe")).otherwise(F.lit("no change"))
    )
    return scored.agg(
        F.count_if(F.col("_side") == "before").alias("n_before"), F.count_if(F.col("_side") == "after").alias("n_after"),
        pct("before").alias("pct_before"), pct("after").alias("pct_after"),
    ).withColumns({"delta": change, "verdict": verdict})


def pair(
    df: DataFrame, key: str, column: str, high: int, low: int, predict: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The same row with two values of one column: both probabilities and their difference."""
    kind = dict(df.dtypes)[column]
    values = F.array(F.lit(high).cast(kind), F.lit(low).cast(kind))
    scored = predict(df.drop(column).withColumn(column, F.explode(values)))
    return scored.groupBy(key).agg(
        F.max(F.when(F.col(column) == high, F.col("severe_probability"))).alias("p_high"),
        F.max(F.when(F.col(column) == low, F.col("severe_probability"))).alias("p_low"),
    ).withColumn("delta", F.col("p_high") - F.col("p_low"))
