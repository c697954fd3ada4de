import json
import os


from curatio.session import local_path, scratch_path
from curatio.sinks import files as sinks
from curatio.sources import files as sources
from curatio.spec import JobConfig, run_path_columns, spec_for


def _mk(path):
    os.makedirs(local_path(path), exist_ok=True)
    return local_path(path)


def test_reference_shard_layout_in_numeric_order(spark):
    root = _mk(scratch_path(spark, "cot"))
    os.makedirs(f"{root}/llm", exist_ok=True)
    # shard 10 must come after shard 2 even though "10" < "2" as text
    for i, items in [(0, ["a", "b"]), (2, ["c"]), (10, ["d", "e"]), (1, [])]:
        with open(f"{root}/llm/train_CoT_{i}.json", "w") as f:
            json.dump(items, f)
    with open(f"{root}/llm/test_CoT_0.json", "w") as f:
        json.dump(["t0", "t1"], f)
    df = sources.read_output_arrays(spark, f"{root}/llm/*_CoT_*.json")
    got = sorted((r.split, r.row_pos, r.output) for r in df.collect())
    assert got == [("test", 0, "t0"), ("test", 1, "t1"), ("train", 0, "a"), ("train", 1, "b"),
                   ("train", 2, "c"), ("train", 3, "d"), ("train", 4, "e")]


def test_json_splits_roundtrip_with_remap(spark):
    root = scratch_path(spark, "splits")
    df = spark.createDataFrame([("validation", i, f"x{i}") for i in range(5)] +
                               [("train", i, f"y{i}") for i in range(7)], "split string, row_pos long, v string")
    sinks.write_json_splits(df, root, "ds", {"train": "train", "test": "validation"}, num_partitions=3)
    back = sources.read_json_splits(spark, root, "ds", "v string", ["train", "test"]).collect()
    assert sorted((r.split, r.row_pos, r.v) for r in back) == \
        sorted([("test", i, f"x{i}") for i in range(5)] + [("train", i, f"y{i}") for i in range(7)])


def test_json_array_file(spark):
    root = _mk(scratch_path(spark, "arr"))
    with open(f"{root}/SVAMP.json", "w") as f:
        json.dump([{"Body": "b0", "Question": "q0", "Equation": "( 1 + 2 )"},
                   {"Body": "b1", "Question": "q1", "Equation": "( 3 )"}], f, indent=2)
    df = sources.read_json_array(spark, f"{root}/SVAMP.json", "Body string, Question string, Equation string")
    assert [(r.row_pos, r.Body) for r in df.orderBy("row_pos").collect()] == [(0, "b0"), (1, "b1")]


def test_list_files_prunes_content(spark):
    root = _mk(scratch_path(spark, "imgs"))
    for n in ["chapter4_page_1.png", "chapter4_page_2.PNG", "notes.txt"]:
        with open(f"{root}/{n}", "wb") as f:
            f.write(b"x" * 10)
    df = sources.list_files(spark, root, "*.png")
    assert [os.path.basename(r.path) for r in df.collect()] == ["chapter4_page_1.png"]
    assert "content" not in df.columns


def test_dynamic_partition_overwrite(spark):
    path = scratch_path(spark, "runs")
    a = spark.createDataFrame([("r0", 1), ("r1", 2)], "run string, v int")
    sinks.write_partitioned(a, path, ["run"])
    sinks.write_partitioned(spark.createDataFrame([("r1", 3)], "run string, v int"), path, ["run"])
    got = sorted((r.run, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("r0", 1), ("r1", 3)]


def test_run_path_text(spark):
    cfg = JobConfig(dataset="cqa")
    df = spark.range(1)
    cols = run_path_columns(cfg)
    r = df.select(*[v.alias(k) for k, v in cols.items()]).collect()[0]
    assert r.config_dir == "cqa/t5-v1_1-base/task_prefix/palm/1.0/gt/0.5/1024/64/AdamW/5e-05"
    assert r.output_dir == "ckpts/" + r.config_dir + "/0"
    none = df.select(run_path_columns(JobConfig(dataset="cqa", llm=None))["config_dir"].alias("c")).collect()[0]
    assert "/None/" in none.c


def test_spec_lookup():
    assert spec_for("esnli").train_cap == 550_000 and spec_for("esnli", "small").train_cap == 55_000
    assert spec_for("cqa").split_map["test"] == "validation"
    import pytest
    with pytest.raises(ValueError):
        spec_for("nope")
    with pytest.raises(ValueError):
        JobConfig(dataset="cqa", llm=None, model_type="task_prefix").validate()


def test_doc_text_files(spark):
    from curatio.operators.pages import doc_text
    path = scratch_path(spark, "doctext")
    pages_df = spark.createDataFrame([("d1", 2, "b\n"), ("d1", 1, "a\n"), ("d2", 1, "z")],
                                     "doc string, page long, text string")
    sinks.write_doc_texts(doc_text(pages_df), path)
    got = {r.doc: r.text for r in spark.read.parquet(path).collect()}
    assert got == {"d1": "a\nb\n", "d2": "z"}


def test_lines_append_batch_after_batch(spark):
    path = scratch_path(spark, "append")
    first = spark.createDataFrame([(0, "a\t[]"), (1, "b\t[]")], "row_pos long, line string")
    second = spark.createDataFrame([(2, "c\t[]")], "row_pos long, line string")
    sinks.write_lines(first, path, num_partitions=2)
    sinks.write_lines(second, path, mode="append", num_partitions=1)
    got = sorted(r.value for r in spark.read.text(path).collect())
    assert got == ["a\t[]", "b\t[]", "c\t[]"]
