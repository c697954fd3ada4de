import hashlib
import math

import pytest
from pyspark.sql import functions as F

from curatio.operators import sampling
from curatio.session import scratch_path


@pytest.mark.parametrize("seed", [0, 1, 42])
@pytest.mark.parametrize("n,frac", [(100, 0.1), (37, 0.3), (10, 0.5)])
def test_exact_split_disjoint_covering_exact(spark, seed, n, frac):
    df = spark.range(n).withColumnRenamed("id", "row_pos")
    rows = sampling.exact_split(df, seed, frac).collect()
    test = {r.row_pos for r in rows if r.part == "test"}
    train = {r.row_pos for r in rows if r.part == "train"}
    assert len(test) == math.ceil(frac * n)
    assert test.isdisjoint(train) and test | train == set(range(n))


def test_split_is_deterministic_and_seeded(spark):
    df = spark.range(200).withColumnRenamed("id", "row_pos")
    a = {r.row_pos for r in sampling.exact_split(df, 3, 0.2).where("part = 'test'").collect()}
    b = {r.row_pos for r in sampling.exact_split(df.repartition(5), 3, 0.2).where("part = 'test'").collect()}
    c = {r.row_pos for r in sampling.exact_split(df, 4, 0.2).where("part = 'test'").collect()}
    assert a == b and a != c


def test_subsample_and_carve_valid(spark):
    df = spark.range(100).select(F.col("id").alias("row_pos"),
                                 F.when(F.col("id") < 80, F.lit("train")).otherwise(F.lit("test")).alias("split"))
    assert sampling.subsample(df.where("split = 'train'"), 0.25, seed=0).count() == 80 - math.ceil(0.75 * 80)
    c = {r.split: r["count"] for r in sampling.carve_valid(df).groupBy("split").count().collect()}
    assert c == {"train": 72, "valid": 8, "test": 20}


def test_permute_head(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_pos")
    c = {r.split: r["count"] for r in sampling.permute_head_split(df, 800).groupBy("split").count().collect()}
    assert c == {"train": 800, "test": 200}


def test_permute_head_keeps_the_permuted_order(spark):
    df = spark.range(30).select(F.col("id").alias("row_pos"), F.col("id").alias("key"))
    rows = sampling.permute_head_split(df, 20, seed=0).collect()
    want = sorted(range(30), key=lambda k: (hashlib.md5(f"0:{k}".encode()).hexdigest(), k))
    got = {s: [r.key for r in sorted((r for r in rows if r.split == s), key=lambda r: r.row_pos)] for s in ("train", "test")}
    assert got == {"train": want[:20], "test": want[20:]}
    assert sorted(r.row_pos for r in rows if r.split == "test") == list(range(10))


def test_subsample_train_leaves_other_splits(spark):
    df = spark.range(100).select(F.col("id").alias("row_pos"),
                                 F.when(F.col("id") < 80, F.lit("train")).otherwise(F.lit("test")).alias("split"))
    kept = {r.row_pos for r in sampling.subsample_train(df, 0.25, seed=0).collect()}
    alone = {r.row_pos for r in sampling.subsample(df.where("split = 'train'"), 0.25, seed=0).collect()}
    assert kept == alone | set(range(80, 100))


def test_splits_run_their_input_once(spark):
    """The cut is taken on checkpointed ranks: no plan scans the input beside them."""
    df = spark.range(50).select(F.col("id").alias("row_pos"), F.lit("train").alias("split"))
    for out in (sampling.carve_valid(df), sampling.exact_split(df, 0, 0.1), sampling.subsample_train(df, 0.5, 0)):
        assert "Range (0, 50" not in out._jdf.queryExecution().toString()


def test_a_cut_is_found_by_counting(spark):
    """Every cut of an unsorted input equals the sorted rank, also where several rounds are needed."""
    want = sorted(range(300), key=lambda k: (hashlib.md5(f"5:{k}".encode()).hexdigest(), k))
    keys = spark.range(300).select(F.col("id").alias("row_pos")).repartition(4)
    for count in (1, 2, 150, 299, 300):
        for small in (0, 10):
            assert sampling.hash_cut(keys, 5, count, small=small)[1] == want[count - 1]


def test_a_stored_input_is_split_by_one_filter(spark):
    path = scratch_path(spark, "stored")
    spark.range(400).select(F.col("id").alias("row_pos"), F.lit("train").alias("split"), F.repeat(F.lit("x"), 50).alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (sampling.carve_valid(df, stored=True), sampling.exact_split(df, 0, 0.1, stored=True), sampling.subsample_train(df, 0.5, 0, stored=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "FileScan" in plan
    assert sampling.carve_valid(df, stored=True).where("split = 'valid'").count() == 40
    for size, n in ((0, 0), (400, 400), (1, 1), (500, 400)):
        assert sampling.exact_split(df, 1, size, stored=True).where("part = 'test'").count() == n
    assert sampling.exact_split(df.limit(0), 1, 0.5).count() == 0


def test_a_permutation_is_written_as_it_lies(spark):
    """The ranges of the hash are known, so nothing samples them, and the writes sort nothing."""
    from curatio.sinks import files as sinks
    n, head = 900, 70
    df = spark.range(n).select(F.col("id").alias("row_pos"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("input")).repartition(5)
    rows = sampling.permute_head_split(df, head, seed=3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    order = [f"q{k}" for k in sorted(range(n), key=lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k))]
    paths = sinks.write_json_splits(rows, scratch_path(spark, "permuted"), "ds", {"train": "train", "test": "test"}, in_order=True)
    for path, want in zip(paths, (order[:head], order[head:]), strict=True):
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("p"), F.monotonically_increasing_id().alias("i"), "value").collect()
        assert [r.value for r in sorted(lines, key=lambda r: (r.p, r.i))] == [f'{{"input":"{q}"}}' for q in want]
    nulls = sampling.seeded_rank(spark.createDataFrame([(1,), (None,), (2,)], "row_pos long"), 0).collect()
    assert sorted(r._rank for r in nulls) == [0, 1, 2] and [r._rank for r in nulls if r.row_pos is None] == [0]
