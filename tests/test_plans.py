"""Plan checks: Python only in equation evaluation, bounded broadcasts, pushed-down scans."""

import pytest

import __spark_entry__ as E
from curatio.plans.registry import QUERIES
from tests.conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
EQUATION_KEYS = {"job_evaluation", "equation_values", "equation_accuracy", "decoded_eq_accuracy"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _unpartitioned_window_orders(plan: str) -> list[str]:
    """Order specs of windows that have no partition spec (they run in one task)."""
    out = []
    for part in plan.split("windowspecdefinition(")[1:]:
        first = part.split(",")[0]
        if " ASC" in first or " DESC" in first:
            out.append(first.strip())
    return out


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    # Python only where equations are evaluated
    has_py = any(n in plan for n in PY_NODES)
    assert has_py == (key in EQUATION_KEYS), key
    # a window without partitions only over the small tables of one row per partition
    # (_pid), never over the data rows or the input files
    for order in _unpartitioned_window_orders(plan):
        assert order.startswith("_pid#"), (key, order)


def test_vocab_is_broadcast(spark):
    plan = _plan(E.queries()["encode_inputs"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def _read_schemas(spark, df):
    import re
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(mode))


def test_scans_read_only_needed_columns(spark):
    nli = _read_schemas(spark, E.queries()["nli_pair_input"](spark, SF_SMALL))
    assert "struct<doc_id:bigint,text:string>" in nli          # lang, source, n_chars pruned
    assert "struct<doc_id:bigint>" in nli                      # labels: only the join key
    pre = _read_schemas(spark, E.queries()["page_prefix"](spark, SF_SMALL))
    assert pre == ["struct<o_orderkey:bigint>"]


def test_positions_never_deal_rows_by_the_group_alone(spark):
    """A split holding most rows isn't gathered in one task, and files aren't numbered in one window."""
    import re

    from pyspark.sql import functions as F

    from curatio.operators.positions import file_positions, group_positions
    from curatio.session import scratch_path
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(200).select((F.col("id") % 2).cast("string").alias("split"), "id")
        plan = _plan(group_positions(df, ["split"], ["id"]))
        joined = [k for k in re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)]
        assert any(k.startswith("_rp#") for k in joined)
        path = scratch_path(spark, "plan-lines")
        df.select("split", F.col("id").cast("string").alias("value")).write.partitionBy("split").text(path)
        rows = spark.read.schema("value string, split string").text(path)
        got = file_positions(rows, "pos", ["split"])
        assert "windowspecdefinition" not in _plan(got) and "hashpartitioning(split" not in _plan(got)
        assert sorted((r.split, r.pos) for r in got.collect()) == [(s, i) for s in "01" for i in range(100)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
