"""Array files read by many tasks; damaged files, lines and elements."""

import json
import os
import random

import pytest
from pyspark.sql import Window

from curatio.session import local_path, scratch_path
from curatio.sources import files as sources
from curatio.sources import json_arrays
from curatio.sources.json_arrays import DamagedInput, as_strings, scan_arrays, whole_strings


def _folder(spark, name):
    root = local_path(scratch_path(spark, name))
    os.makedirs(root)
    return root


def _write(root, name, text):
    with open(f"{root}/{name}.json", "w") as f:
        f.write(text)


def _by_file(rows, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.idx)):
        out.setdefault(os.path.basename(r.path)[:-5], []).append(r[value])
    return out


@pytest.fixture
def tiny_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_in_many_ranges_and_every_kind_of_damage(spark, tiny_ranges):
    root = _folder(spark, "arrays")
    rnd = random.Random(5)
    odd = ['a,b "q" [x] {y} \\ \\" é , ,', "", ",", "]", "[", "\\", '"', "x\ny", "{", "\\\\,"]
    big = [rnd.choice(odd) + str(i) for i in range(3000)]
    _write(root, "big", json.dumps(big))
    good = {"two": '["c", "d"]\n', "none": " [ ]", "one": '[",,,"]'}
    bad_files = {"zero": ("", "empty file"), "cut": ('["c", "d', "cut off: the array does not end"), "comma": ('["c","d",', "cut off: the array does not end"),
                 "more": ('["a"], "b"', "text after the end of the array"), "object": ('{"a":1}', "does not start with a JSON array")}
    bad_elements = {"number": ('["a", 1, null, ["x"], "b"]', {1: "not a string", 2: "not a string", 3: "not a string"}),
                    "hole": ('["a",,"b"]', {1: "not a JSON value"}), "trail": ('["a",]', {1: "not a JSON value"}),
                    "glued": ('["a""b","c"]', {0: "not a JSON value"}), "nested": ('["a"]["b"]', {0: "not a JSON value"})}
    for k, v in good.items():
        _write(root, k, v)
    for k, (text, _) in {**bad_files, **bad_elements}.items():
        _write(root, k, text)
    scanned = scan_arrays(spark, f"{root}/*.json")
    assert spark.read.option("lineSep", ",").text(f"{root}/big.json").rdd.getNumPartitions() > 10
    files = as_strings(scanned)
    got = _by_file(files.elements.collect(), "output")
    assert got["big"] == big and got["two"] == ["c", "d"] and got["one"] == [",,,"] and "none" not in got
    assert got["number"] == ["a", None, None, None, "b"] and not set(got) & set(bad_files)
    problems = {}
    for r in files.problems.collect():
        problems.setdefault(os.path.basename(r.path)[:-5], {})[r.place] = r.reason
    assert problems == {**{k: {None: why} for k, (_, why) in bad_files.items()}, **{k: why for k, (_, why) in bad_elements.items()}}


def test_a_cut_shard_stops_the_reader_or_is_listed(spark):
    root = _folder(spark, "shards")
    for i, text in enumerate(['["a", "b"]', '["c", "d"', '["e", 5]']):
        _write(root, f"train_CoT_{i}", text)
    with pytest.raises(DamagedInput, match="train_CoT_1.*cut off"):
        sources.read_output_arrays(spark, f"{root}/*.json")
    listed = scratch_path(spark, "listed")
    rows = sources.read_output_arrays(spark, f"{root}/*.json", quarantine=listed).collect()
    assert sorted((r.shard, r.row_pos, r.output) for r in rows if r.output) == [(0, 0, "a"), (0, 1, "b"), (2, 2, "e")]
    assert [(r.shard, r.row_pos) for r in rows if r.output is None] == [(2, 3)]
    assert sorted((os.path.basename(r.path), r.place) for r in spark.read.parquet(listed).collect()) == [("train_CoT_1.json", None), ("train_CoT_2.json", 1)]


def test_object_arrays_lacking_a_column_or_of_another_type(spark):
    root = _folder(spark, "objects")
    _write(root, "a", json.dumps([{"A": 1, "B": "x,{["}, {"A": 2}, {"A": "z", "B": "w"}, 7, {"A": None, "B": None}], indent=1))
    with pytest.raises(DamagedInput, match="missing B"):
        sources.read_json_array(spark, f"{root}/a.json", "A int, B string")
    listed = scratch_path(spark, "listed")
    rows = sources.read_json_array(spark, f"{root}/a.json", "A int, B string", quarantine=listed)
    assert [(r.A, r.B) for r in rows.orderBy("row_pos").collect()] == [(1, "x,{["), (None, None), (None, None), (None, None), (None, None)]
    assert {r.place: r.reason for r in spark.read.parquet(listed).collect()} == {1: "missing B", 2: "does not fit the schema", 3: "not a JSON object"}
    loose = sources.read_json_array(spark, f"{root}/a.json", "A int, B string", required=["A"], quarantine=listed)
    assert [r.A for r in loose.orderBy("row_pos").collect()] == [1, 2, None, None, None]


def test_json_lines_cut_or_without_a_column(spark):
    root = _folder(spark, "lines")
    os.makedirs(f"{root}/ds")
    _write(f"{root}/ds", "ds_train", '{"a": 1, "b": "x"}\n\n{"a": 2}\n{"a": 3, "b"\n{"a": 4, "b": null}\n')
    df = sources.read_json_splits(spark, root, "ds", "a int, b string", ["train"])
    for use in (df.collect, df.count):
        with pytest.raises(Exception, match="damaged line"):
            use()
    listed = scratch_path(spark, "listed")
    rows = sources.read_json_splits(spark, root, "ds", "a int, b string", ["train"], quarantine=listed)
    assert [(r.a, r.b, r.row_pos) for r in rows.orderBy("row_pos").collect()] == [(1, "x", 0), (None, None, 1), (None, None, 2), (4, None, 3)]
    assert {r.place: r.reason for r in spark.read.parquet(listed).collect()} == {1: "missing b", 2: "not a JSON object"}


def test_whole_strings(spark):
    cases = {'["a", "b,"]': ["a", "b,"], " []\n": [], '["\\"", "\\\\"]': ['"', "\\"], '["a", 1]': None, '["a"': None, "": None, '["a"] x': None, '{"a": "b"}': None}
    array, reason = whole_strings("t")
    got = {r.t: r.a for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", array.alias("a"), reason.alias("r")).collect()}
    assert got == cases


def test_parts_of_elements_are_found_in_file_order_without_a_row_per_comma(spark, tiny_ranges):
    root = _folder(spark, "parts")
    rnd = random.Random(7)
    odd = ["a,b,c,,,", 'q"[,]', "\\", "\\\\,\\", '\\"', "é,ü", "", "{,}"]
    want = {n: [{"v": rnd.choice(odd) * 3 + str(i), "w": [i, {"x": ","}]} for i in range(k)] for n, k in (("a", 900), ("b", 1), ("c", 30))}
    for n, values in want.items():
        _write(root, n, json.dumps(values))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")      # elements go on over batches
    try:
        raw = spark.read.option("lineSep", ",").text(f"{root}/*.json")
        parts = json_arrays._element_parts(spark, raw, Window.partitionBy("path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
        ranges = parts.select("path", "blk").distinct().count()
        assert raw.count() > 5000 and ranges > 10 and 931 <= parts.count() <= 931 + 2 * ranges
        got = _by_file(scan_arrays(spark, f"{root}/*.json").elements.collect(), "text")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {n: [json.loads(t) for t in texts] for n, texts in got.items()} == want


def test_small_files_are_cut_alike_as_rows_and_as_pieces(spark):
    root = _folder(spark, "whole")
    for i, text in enumerate(['[{"a": "x,\\", y"}, [1, {"b": 2}], 7]', "[]", "[1],", ",", "[1, 2", '﻿["a",,\n "b"]\n', " ", '["é,", "\\\\"] x', '[{"a": 1} {"b": 2}]']):
        _write(root, f"f{i}", text)
    raw, per_file = spark.read.option("lineSep", ",").text(f"{root}/*.json"), Window.partitionBy("path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    pieces, rows = (sorted(map(tuple, json_arrays._element_parts(spark, raw, per_file, w).collect()))
                    for w in (None, spark.read.text(f"{root}/*.json", wholetext=True)))
    assert rows == pieces and len({r[0] for r in rows}) == 9


def test_small_files_take_no_row_per_comma(spark, monkeypatch):
    root = _folder(spark, "one-row")
    _write(root, "a", json.dumps([{"A": i, "B": "x,y"} for i in range(50)]))

    def refuse_pieces(batches):
        for _ in batches:
            raise AssertionError("read piece by piece")
            yield
    monkeypatch.setattr(json_arrays, "_segments", refuse_pieces)
    assert [r.A for r in sources.read_json_array(spark, f"{root}/a.json", "A int, B string").orderBy("row_pos").collect()] == list(range(50))


def test_objects_accepted_after_one_parsing_are_those_of_all_checks(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 1, "b": "NaN"}', '{"a": NaN, "b": "x"}', '{"a": 1, "b": NaN}', '{"a": 1, "b": Infinity}', '[{"a": 1, "b": "x"}]', '{"a": 1, "b": "x"',
             ' {"a": 1, "b": "x"} ', "{'a': 1, 'b': 'x'}", '{"a": "q", "b": "x"}', '{"b": "x"}', '{"a": null, "b": null}', "", "7", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r._why, r._r) for r in json_arrays.with_object(df, "t", "a int, b string", ["a", "b"]).collect()}
    want = {'{"a": NaN, "b": "x"}': "not a JSON object", '{"a": 1, "b": NaN}': "not a JSON object", '{"a": 1, "b": Infinity}': "not a JSON object", '[{"a": 1, "b": "x"}]': "not a JSON object",
            '{"a": 1, "b": "x"': "not a JSON object", '{"a": "q", "b": "x"}': "does not fit the schema", '{"b": "x"}': "missing a", "": "not a JSON object", "7": "not a JSON object", None: "not a JSON object"}
    assert {t: why for t, (why, _) in got.items() if why} == want
    assert all((r is None) == (why is not None) for why, r in got.values()) and got['{"a": 1, "b": "NaN"}'][1].b == "NaN"
    rows = json_arrays.with_object(df, "t", "a int, b string", ["a", "b"]).where("_why IS NULL")
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
