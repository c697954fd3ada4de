"""Equation evaluation as a Spark job.

Two forms.  ``equation_values``: the distinct equations of a table (``distinct`` is a
map-side partial aggregate) evaluated in Arrow batches by ``mapInPandas``.
``evaluate_columns``: a value column next to each text column through a scalar pandas UDF;
each distinct text of a batch is evaluated once, and no row is shuffled or joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.functions.equation import evaluate

VALUE_SCHEMA = "equation string, value double"


def _eval_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        vals = [evaluate(t) for t in pdf["equation"]]
        yield pd.DataFrame({"equation": pdf["equation"], "value": pd.Series(vals, dtype="float64")})


def equation_values(texts: DataFrame, text_col: str = "equation") -> DataFrame:
    """(equation, value) for each distinct non-NULL text; value NULL = not evaluable."""
    d = texts.select(F.col(text_col).alias("equation")).where(F.col("equation").isNotNull()).distinct()
    return d.mapInPandas(_eval_batches, VALUE_SCHEMA)


def _values_of_batch(texts: pd.Series) -> pd.Series:
    """Value of each equation text; each distinct text in an Arrow batch is evaluated once."""
    uniq = texts.dropna().unique()
    values = {t: evaluate(t) for t in uniq}
    return texts.map(values).astype("float64")


_UDF = None


def equation_value(col):
    """Scalar pandas UDF column: value of an equation text (NULL when not evaluable)."""
    global _UDF
    if _UDF is None:
        _UDF = F.pandas_udf(_values_of_batch, "double")
    return _UDF(col)


def evaluate_columns(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add a value column per text column (text column → value column).

    Row-aligned Arrow batches: only the text column travels to Python and back, nothing is
    shuffled or joined.  (``equation_values`` is the distinct-first form, for a table of
    distinct equations.)
    """
    out = df
    for c, o in cols.items():
        out = out.withColumn(o, equation_value(F.col(c)))
    return out
