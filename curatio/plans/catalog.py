"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle.

Every query reads the driver's tables through ``curatio.plans.fixtures`` (whole tables,
whole texts) and returns a DataFrame; the oracle SQL computes the same rows from the same
tables in DuckDB.  Arrays are returned as comma-joined strings so both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.operators import align, metrics, parse, prompts
from curatio.operators.equations import equation_values as _equation_values
from curatio.plans import fixtures as fx
from curatio.plans import sql_text as S
from curatio.plans.fixture_sql import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


NL = "chr(10)"

# ---------------------------------------------------------------------------------------
# E01–E09: parsing model outputs
# ---------------------------------------------------------------------------------------

_PARSE_CASES = {
    "parse_cqa_palm": ("cqa", "palm", "cqa_llm"),
    "parse_cqa_gpt": ("cqa", "gpt", "cqa_llm"),
    "parse_svamp_palm": ("svamp", "palm", "svamp_full"),
    "parse_svamp_gpt": ("svamp", "gpt", "svamp_full"),
    "parse_esnli_palm": ("esnli", "palm", "nli_llm"),
    "parse_esnli_gpt": ("esnli", "gpt", "nli_llm"),
    "parse_anli_palm": ("anli1", "palm", "nli_llm"),
    "parse_anli_gpt": ("anli1", "gpt", "nli_llm"),
}


def _parse_query(dataset: str, model: str, fixture: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = getattr(fx, fixture)(spark, sf_dir).select("split", "row_pos", "output")
        on_bad = "quarantine" if (dataset, model) == ("cqa", "palm") else "fail"
        return parse.parse_outputs(src, dataset, model, on_bad=on_bad).drop("output")
    return run


def _parse_sql(dataset: str, model: str, fixture: str) -> str:
    r, lab = S.parse_select(dataset, model)
    extra = ""
    if (dataset, model) == ("cqa", "palm"):
        ok = S.two(S.rs(S.head("output", "Q:")), "So the answer is")
        extra = (f", case when {ok} then NULL else "
                 f"'output does not split in two on the answer marker' end as parse_error")
    return (with_ctes(fixture) +
            f"SELECT split, row_pos, {r} AS rationale, {lab} AS label{extra} FROM {fixture}")


for _k, (_d, _m, _f) in _PARSE_CASES.items():
    register(_k, _parse_sql(_d, _m, _f))(_parse_query(_d, _m, _f))

# ---------------------------------------------------------------------------------------
# P01–P09 prompts and labels, J01 attach, A01 accuracy
# ---------------------------------------------------------------------------------------


def _cqa_input_sql(alias: str = "") -> str:
    a = alias + "." if alias else ""
    parts = [f"{a}question", f"{NL} || 'Answer Choices:'"]
    for i, letter in enumerate("abcde"):
        parts.append(f"{NL} || '({letter}) ' || {a}c{i}")
    return " || ".join(parts)


def _cqa_with_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.cqa_src(spark, sf_dir)
    return s.select("split", "row_pos", "question",
                    F.array("c0", "c1", "c2", "c3", "c4").alias("choices"), "answer")


@register("cqa_prompt", with_ctes("cqa_src") +
          f"SELECT split, row_pos, {_cqa_input_sql()} AS input, answer AS label FROM cqa_src")
def q_cqa_prompt(spark, sf_dir):
    return prompts.cqa_prompt(_cqa_with_choices(spark, sf_dir))


@register("svamp_prompt", with_ctes("svamp_full") +
          f"SELECT split, row_pos, body || {NL} || question AS input, equation AS label FROM svamp_full")
def q_svamp_prompt(spark, sf_dir):
    s = fx.svamp_full(spark, sf_dir).select("split", "row_pos", "body", "question", "equation")
    return prompts.svamp_prompt(s)


@register("asdiv_prompt", with_ctes("asdiv_src") +
          f"SELECT split, row_pos, body || {NL} || question AS input, split_part(answer, ' ', 1) AS label "
          "FROM asdiv_src")
def q_asdiv_prompt(spark, sf_dir):
    return prompts.asdiv_prompt(fx.asdiv_src(spark, sf_dir))


_NLI_NAME_SQL = ("case label when 0 then 'entailment' when 1 then 'neutral' when 2 then 'contradiction' "
                 "else cast(label as varchar) end")


@register("nli_label_names", with_ctes("nli_src") +
          f"SELECT split, row_pos, {_NLI_NAME_SQL} AS label FROM nli_src")
def q_nli_label_names(spark, sf_dir):
    return prompts.nli_label_names(fx.nli_src(spark, sf_dir).select("split", "row_pos", "label"))


@register("nli_pair_input", with_ctes("nli_src") +
          "SELECT split, row_pos, premise || '</s>' || hypothesis AS input FROM nli_src")
def q_nli_pair_input(spark, sf_dir):
    s = fx.nli_src(spark, sf_dir).select("split", "row_pos", "premise", "hypothesis")
    return prompts.nli_pair_input(s)


def attach_cqa(spark: SparkSession, sf_dir: str, model: str = "gpt") -> DataFrame:
    """CQA prompts with the model's label and rationale attached by position (J01, P06)."""
    src = prompts.cqa_prompt(_cqa_with_choices(spark, sf_dir))
    outs = parse.parse_outputs(fx.cqa_llm(spark, sf_dir), "cqa", model,
                               rationale_col="llm_rationale", label_col="llm_label").drop("output")
    j = align.attach_by_position(src, outs, ["split", "row_pos"])
    if "rationale" in j.columns:
        j = j.drop("rationale")
    return j.withColumnRenamed("llm_rationale", "rationale")


_ATTACH_SQL_BODY = (lambda r, lab: with_ctes("cqa_src", "cqa_llm") +
                    f"SELECT coalesce(s.split, l.split) AS split, coalesce(s.row_pos, l.row_pos) AS row_pos, "
                    f"{_cqa_input_sql('s')} AS input, s.answer AS label, "
                    f"{lab.replace('output', 'l.output')} AS llm_label, "
                    f"{r.replace('output', 'l.output')} AS rationale "
                    "FROM cqa_src s FULL OUTER JOIN cqa_llm l ON s.split = l.split AND s.row_pos = l.row_pos")
ATTACH_SQL = _ATTACH_SQL_BODY(*S.parse_select("cqa", "gpt"))


@register("attach_llm", ATTACH_SQL)
def q_attach_llm(spark, sf_dir):
    return attach_cqa(spark, sf_dir)


@register("task_prefix", with_ctes("cqa_src") +
          f"SELECT split, row_pos, 'predict: ' || {_cqa_input_sql()} AS pred_input, "
          f"'explain: ' || {_cqa_input_sql()} AS expl_input FROM cqa_src")
def q_task_prefix(spark, sf_dir):
    p = prompts.cqa_prompt(_cqa_with_choices(spark, sf_dir))
    return prompts.task_prefix(p).select("split", "row_pos", "pred_input", "expl_input")


@register("label_substitution",
          f"SELECT split, row_pos, case when split = 'train' then llm_label else label end AS label "
          f"FROM ({ATTACH_SQL}) a")
def q_label_substitution(spark, sf_dir):
    return prompts.label_substitution(attach_cqa(spark, sf_dir)).select("split", "row_pos", "label")


@register("text_accuracy",
          "SELECT split, avg(cast((llm_label IS NOT DISTINCT FROM label) as double)) AS accuracy, "
          f"cast(count(*) as bigint) AS n FROM ({ATTACH_SQL}) a GROUP BY split")
def q_text_accuracy(spark, sf_dir):
    return metrics.text_accuracy(attach_cqa(spark, sf_dir), "llm_label", "label", ["split"])


# ---------------------------------------------------------------------------------------
# X01 equations, A02 equation accuracy
# ---------------------------------------------------------------------------------------

_SVAMP_PALM = S.parse_select("svamp", "palm")


@register("equation_values", with_ctes("svamp_full") +
          "SELECT equation, max(value) AS value FROM ("
          " SELECT equation, gold_value AS value FROM svamp_full"
          f" UNION ALL SELECT {_SVAMP_PALM[1]} AS equation, llm_value AS value FROM svamp_full"
          ") t GROUP BY equation")
def q_equation_values(spark, sf_dir):
    s = parse.parse_outputs(fx.svamp_full(spark, sf_dir), "svamp", "palm")
    texts = s.select("equation").unionByName(s.select(F.col("label").alias("equation")))
    return _equation_values(texts)


@register("equation_accuracy", with_ctes("svamp_full") +
          "SELECT avg(cast(coalesce(llm_value = gold_value, false) as double)) AS accuracy, "
          "cast(count(*) as bigint) AS n FROM svamp_full")
def q_equation_accuracy(spark, sf_dir):
    s = parse.parse_outputs(fx.svamp_full(spark, sf_dir), "svamp", "palm", label_col="llm_label")
    return metrics.equation_accuracy(s, "llm_label", "equation", group=())

