"""Prompt and label projections: one codegen'd projection each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.functions.text import py_str

# --- fixed values ----------------------------------------------------------------------
CHOICE_LETTERS = ["a", "b", "c", "d", "e"]
NLI_LABEL_NAMES = {0: "entailment", 1: "neutral", 2: "contradiction"}
EOS_TOKEN = "</s>"
PREDICT_PREFIX = "predict: "
EXPLAIN_PREFIX = "explain: "
# ---------------------------------------------------------------------------------------


def cqa_prompt(df: DataFrame, question: str = "question", choices: str = "choices",
               answer: str = "answer") -> DataFrame:
    """``{question}\\nAnswer Choices:\\n(a) c0 ... (e) c4``; label = answer.

    Fewer than five choices fails the job, as indexing does in the reference.
    """
    ch = F.col(choices)
    parts = [py_str(question), F.lit("\nAnswer Choices:")]
    for i, letter in enumerate(CHOICE_LETTERS):
        parts += [F.lit(f"\n({letter}) "), py_str(F.get(ch, i))]
    guard = F.when(F.size(ch) < len(CHOICE_LETTERS),
                   F.raise_error(F.lit("a question has fewer than five answer choices")).cast("string"))
    return (df.withColumn("input", F.coalesce(guard, F.concat(*parts)))
            .withColumn("label", F.col(answer))
            .drop(question, choices, answer))


def body_question_prompt(df: DataFrame, body: str = "body", question: str = "question",
                         null_as_text: bool = True) -> DataFrame:
    """``Body\\nQuestion`` (SVAMP formats NULL as ``None``; ASDiv concatenation gives NULL)."""
    b = py_str(body) if null_as_text else F.col(body)
    q = py_str(question) if null_as_text else F.col(question)
    return df.withColumn("input", F.concat(b, F.lit("\n"), q)).drop(body, question)


def svamp_prompt(df: DataFrame, equation: str = "equation") -> DataFrame:
    return body_question_prompt(df).withColumn("label", F.col(equation)).drop(equation)


def asdiv_prompt(df: DataFrame, answer: str = "answer") -> DataFrame:
    """label = text of the answer before its first space."""
    return (body_question_prompt(df, null_as_text=False)
            .withColumn("label", F.substring_index(F.col(answer), " ", 1)).drop(answer))


def nli_label_names(df: DataFrame, label: str = "label") -> DataFrame:
    """0/1/2 → entailment/neutral/contradiction, other values printed unchanged."""
    c = F.col(label)
    expr = F.when(c == 0, F.lit(NLI_LABEL_NAMES[0]))
    for k in (1, 2):
        expr = expr.when(c == k, F.lit(NLI_LABEL_NAMES[k]))
    return df.withColumn(label, expr.otherwise(c.cast("string")))


def nli_pair_input(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """premise + eos string + hypothesis (NULL propagates, unlike concat_ws)."""
    return (df.withColumn("input", F.concat(F.col(premise), F.lit(EOS_TOKEN), F.col(hypothesis)))
            .drop(premise, hypothesis))


def task_prefix(df: DataFrame, input_col: str = "input") -> DataFrame:
    return (df.withColumn("pred_input", F.concat(F.lit(PREDICT_PREFIX), F.col(input_col)))
            .withColumn("expl_input", F.concat(F.lit(EXPLAIN_PREFIX), F.col(input_col))))


def label_substitution(df: DataFrame, split: str = "split", label: str = "label",
                       llm_label: str = "llm_label") -> DataFrame:
    """Train rows take the model's label; valid and test keep the gold label."""
    return df.withColumn(label, F.when(F.col(split) == "train", F.col(llm_label)).otherwise(F.col(label)))
