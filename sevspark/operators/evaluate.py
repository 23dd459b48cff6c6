"""Classifier evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


def confusion(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one pass."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, F1 and recall from a confusion row; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keys,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fn).alias("recall"),
    )


def auc(df: DataFrame, label: str, score: str, series: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; a positive beats every lower-scored negative, ties count half.

    Rows collapse to one per distinct score before the ordered pass.
    """
    per_score = df.groupBy(*series, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    below = Ordered(per_score, series, ["_score"], unique=True).running_sum({"_cum": "_neg"}).rows()
    wins = F.col("_pos") * (F.col("_cum") - F.col("_neg") / 2)
    return below.groupBy(*series).agg(
        F.try_divide(F.sum(wins), F.sum("_pos") * F.sum("_neg").cast("double")).alias("auc")
    )
