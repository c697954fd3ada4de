"""Extraction of (rationale, label) from free-text model outputs.

Every rule is a native Catalyst expression, so a parse is one projection inside whole-stage
codegen: no shuffle, no Python.  ``parse_outputs`` is the single entry point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.functions import text as T

# --- fixed values: markers the outputs are cut on -------------------------------------
Q_MARK = "Q:"
SO_ANSWER = "So the answer is"
THE_ANSWER = "The answer is"
ANSWER_COLON = "Answer:"
ANSWER_COLON_SPACE = "Answer: "
PREMISE = "Premise"
PREMISE_COLON = "Premise:"
CHOICE_MARK_RE = r"(?d)\(.\)"       # one-character choice marker such as (a)
PAREN_SPAN_RE = r"(?d)\(.*\)"       # greedy parenthesised span on one line
BLANK = " "
# --------------------------------------------------------------------------------------

ON_BAD = ("fail", "blank", "quarantine")


def _choice_label(tail: Column) -> Column:
    """Text between the 1st and 2nd ``(x)`` marker, stripped, one trailing dot removed."""
    piece = T.strip(F.get(F.split(tail, CHOICE_MARK_RE, -1), 1))
    return (F.when(piece.isNull() | (F.length(piece) == 0), F.lit(BLANK))
            .when(piece.endswith("."), T.drop_last_char(piece))
            .otherwise(piece))


def _paren_label(tail: Column) -> Column:
    span = F.regexp_extract(tail, PAREN_SPAN_RE, 0)
    return F.when(F.length(span) == 0, F.lit(BLANK)).otherwise(span)


def _rules(out: Column, dataset: str, model: str):
    """Return (ok, rationale, label, on_fail) expressions for one dataset/model pair."""
    family = "anli" if dataset.startswith("anli") else dataset
    if family == "cqa":
        rl = T.head(out, Q_MARK)
        rl = T.rstrip(rl) if model == "palm" else T.strip(rl)
        ok = T.splits_in_two(rl, SO_ANSWER)
        rationale = T.rstrip(T.before(rl, SO_ANSWER))
        label = _choice_label(T.after_last(rl, SO_ANSWER))
        # palm: a bad output fails the load; gpt: blanks
        return ok, rationale, label, ("error" if model == "palm" else "blank")
    if family in ("svamp", "asdiv"):
        if family == "asdiv" and model != "palm":
            raise ValueError("asdiv has no parser for model outputs other than 'palm'")
        rl = T.head(out, Q_MARK)
        rl = T.rstrip(rl) if model == "palm" else T.strip(rl)
        ok = T.splits_in_two(rl, THE_ANSWER)
        rationale = T.rstrip(T.before(rl, THE_ANSWER))
        label = _paren_label(T.after_last(rl, THE_ANSWER))
        return ok, rationale, label, "blank"
    if family == "esnli":
        r = T.before(out, ANSWER_COLON)
        rationale = T.rstrip(r) if model == "palm" else T.strip(r)
        piece = T.nth_piece(out, ANSWER_COLON_SPACE, 1)
        label = F.coalesce(T.rstrip(T.before(piece, PREMISE)), F.lit(BLANK))
        return F.lit(True), rationale, label, "blank"
    if family == "anli":
        rl = T.head(out, PREMISE_COLON)
        rl = T.rstrip(rl) if model == "palm" else T.strip(rl)
        ok1 = T.splits_in_two(rl, SO_ANSWER)
        if model == "palm":
            ok = ok1
            rationale = T.rstrip(T.before(rl, SO_ANSWER))
            label = T.drop_last_char(T.lstrip(T.after_last(rl, SO_ANSWER)))
        else:
            ok2 = T.splits_in_two(rl, THE_ANSWER)
            ok = ok1 | ok2
            rationale = F.when(ok1, T.rstrip(T.before(rl, SO_ANSWER))).otherwise(
                T.rstrip(T.before(rl, THE_ANSWER)))
            label = F.when(ok1, T.drop_last_char(T.lstrip(T.after_last(rl, SO_ANSWER)))).otherwise(
                T.drop_last_char(T.lstrip(T.after_last(rl, THE_ANSWER))))
        return ok, rationale, label, "empty"
    raise ValueError(f"unknown dataset {dataset!r}")


def parse_outputs(df: DataFrame, dataset: str, model: str, output_col: str = "output",
                  on_bad: str = "fail", rationale_col: str = "rationale",
                  label_col: str = "label") -> DataFrame:
    """Add ``rationale`` and ``label`` parsed from ``output_col``.

    ``on_bad`` only matters where the reference raises (CQA outputs of the first model):
    ``fail`` stops the job, ``blank`` gives ``' '``, ``quarantine`` keeps the row with NULLs
    and a ``parse_error`` reason.  Rows are never dropped.
    """
    if model not in ("palm", "gpt"):
        raise ValueError(f"unknown model {model!r}")
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    out = F.col(output_col)
    ok, rationale, label, on_fail = _rules(out, dataset, model)
    if on_fail == "blank":
        r = F.when(ok, rationale).otherwise(F.lit(BLANK))
        lab = F.when(ok, label).otherwise(F.lit(BLANK))
        return df.withColumn(rationale_col, r).withColumn(label_col, lab)
    if on_fail == "empty":
        r = F.when(ok, rationale).otherwise(F.lit(""))
        lab = F.when(ok, label).otherwise(F.lit(""))
        return df.withColumn(rationale_col, r).withColumn(label_col, lab)
    # the reference raises here
    if on_bad == "blank":
        return (df.withColumn(rationale_col, F.when(ok, rationale).otherwise(F.lit(BLANK)))
                .withColumn(label_col, F.when(ok, label).otherwise(F.lit(BLANK))))
    if on_bad == "quarantine":
        return (df.withColumn("parse_error", F.when(ok, F.lit(None).cast("string"))
                              .otherwise(F.lit("output does not split in two on the answer marker")))
                .withColumn(rationale_col, F.when(ok, rationale))
                .withColumn(label_col, F.when(ok, label)))
    err = F.raise_error(F.concat(F.lit("cannot split model output in two on '" + SO_ANSWER + "': "),
                                 F.substring(out, 1, 200)))
    return (df.withColumn(rationale_col, F.when(ok, rationale).otherwise(err.cast("string")))
            .withColumn(label_col, F.when(ok, label)))
