"""Accuracy aggregates.

Global or per-split means: a partial aggregate per task, one tiny final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.operators.equations import evaluate_columns


def text_accuracy(df: DataFrame, pred: str = "llm_label", label: str = "label",
                  group: Sequence[str] = ("split",)) -> DataFrame:
    """Exact-match rate; two blanks match.  Empty input gives NULL (NaN there)."""
    hit = F.col(pred).eqNullSafe(F.col(label)).cast("double")
    aggs = [F.avg(hit).alias("accuracy"), F.count(F.lit(1)).cast("bigint").alias("n")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def value_accuracy(df: DataFrame, pred_value: str, label_value: str,
                   group: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose two values are equal; a NULL (not evaluable) never matches."""
    hit = F.coalesce(F.col(pred_value) == F.col(label_value), F.lit(False)).cast("double")
    aggs = [F.avg(hit).alias("accuracy"), F.count(F.lit(1)).cast("bigint").alias("n")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def equation_accuracy(df: DataFrame, pred: str = "llm_label", label: str = "label",
                      group: Sequence[str] = ()) -> DataFrame:
    """Evaluate both sides (X01), then compare values."""
    v = evaluate_columns(df, {pred: "_pv", label: "_lv"})
    return value_accuracy(v, "_pv", "_lv", group)
