import pytest

from pyspark.sql import functions as F

from curatio.operators import align


def test_attach_by_position(spark):
    a = spark.createDataFrame([("train", 0, "x"), ("train", 1, "y")], "split string, row_pos long, input string")
    b = spark.createDataFrame([("train", 1, "B"), ("train", 0, "A")], "split string, row_pos long, llm_label string")
    got = sorted((r.row_pos, r.input, r.llm_label) for r in align.attach_by_position(a, b).collect())
    assert got == [(0, "x", "A"), (1, "y", "B")]


def test_attach_length_mismatch_fails(spark):
    a = spark.createDataFrame([("train", 0, "x"), ("train", 1, "y")], "split string, row_pos long, input string")
    b = spark.createDataFrame([("train", 0, "A")], "split string, row_pos long, llm_label string")
    with pytest.raises(Exception) as e:
        align.attach_by_position(a, b).collect()
    assert "differ in length" in str(e.value)


def test_union_rebased(spark):
    a = spark.createDataFrame([(5, "a5"), (9, "a9")], "row_pos long, v string")
    b = spark.createDataFrame([(3, "b3"), (1, "b1"), (2, "b2")], "row_pos long, v string")
    got = sorted((r.row_pos, r.v, r.source_order) for r in align.union_rebased([a, b]).collect())
    assert got == [(0, "a5", 0), (1, "a9", 0), (2, "b1", 1), (3, "b2", 1), (4, "b3", 1)]


def test_assemble_splits(spark):
    a = spark.createDataFrame([(0, "x")], "row_pos long, v string")
    b = spark.createDataFrame([(0, "y"), (1, "z")], "row_pos long, v string")
    got = sorted((r.split, r.row_pos, r.v) for r in align.assemble_splits({"train": b, "test": a}).collect())
    assert got == [("test", 0, "x"), ("train", 0, "y"), ("train", 1, "z")]


def test_bucketed_tables_attach_without_shuffle(spark):
    from pyspark.sql import functions as F

    from curatio.sinks.files import write_bucketed
    base = spark.range(1000).select(F.lit("train").alias("split"), F.col("id").alias("row_pos"),
                                    F.col("id").cast("string").alias("input"))
    outs = spark.range(1000).select(F.lit("train").alias("split"), F.col("id").alias("row_pos"),
                                    (F.col("id") * 2).cast("string").alias("llm_label"))
    write_bucketed(base, "t_base", ["split", "row_pos"], 4)
    write_bucketed(outs, "t_outs", ["split", "row_pos"], 4)
    j = align.attach_by_position(spark.table("t_base"), spark.table("t_outs"))
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert j.count() == 1000


def test_zip_takes_each_side_once_in_one_exchange(spark):
    a = spark.range(50).select(F.col("id").alias("row_pos"), F.col("id").cast("string").alias("x"))
    b = spark.range(50).select(F.col("id").alias("row_pos"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("y"))
    c = spark.range(50).select(F.col("id").alias("row_pos"), F.lit(None).cast("string").alias("z"), (F.col("id") * 2).alias("w"))
    got = align.zip_by_position([a, b, c])
    assert sorted(map(tuple, got.collect())) == [(i, str(i), [i] if i % 2 == 0 else None, None, 2 * i) for i in range(50)]
    plan = align.zip_by_position([a, b, c])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for other in (b.where("row_pos < 49"), b.unionByName(b.where("row_pos = 3"))):
        with pytest.raises(Exception, match="differ in length"):
            align.zip_by_position([a, other]).collect()
    assert align.zip_by_position([a, b.where("row_pos < 10")], check=False).count() == 10
