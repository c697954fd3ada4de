import pytest
from pyspark.sql import functions as F

from curatio.operators import positions
from curatio.sinks.files import write_lines
from curatio.session import scratch_path
from curatio.sources.files import read_tsv_lines


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dense_positions_any_partitioning(spark, parts):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(parts)
    got = positions.dense_positions(df, ["k"], "pos", num_partitions=5).collect()
    assert sorted(r.pos for r in got) == list(range(1000))
    assert all(r.pos == r.k for r in got)


def test_group_positions_hot_key(spark):
    # one key holds half of the rows: it is spread over the range partitions
    df = spark.range(0, 2000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
                                     F.col("id"))
    got = positions.group_positions(df, ["g"], ["id"], "pos", num_partitions=8).collect()
    hot = sorted((r.id, r.pos) for r in got if r.g == 0)
    assert [p for _, p in hot] == list(range(1000))
    assert all(r.pos == 0 for r in got if r.g != 0)


def test_equal_blocks_not_ntile(spark):
    df = spark.range(10).withColumnRenamed("id", "row_pos")
    got = [r.block for r in positions.equal_blocks(df, 4).orderBy("row_pos").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]


@pytest.mark.parametrize("n,k", [(1, 1), (7, 3), (100, 7), (5, 8)])
def test_block_sizes_differ_by_at_most_one(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "row_pos")
    sizes = [r["count"] for r in positions.equal_blocks(df, k).groupBy("block").count().collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_batch_subset_and_test_mode(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "row_pos")
    assert positions.batch_subset(df, 10, [0, 1]).count() == 20
    assert sorted(r.row_pos // 10 for r in positions.batch_subset(df, 10, [1, 3]).collect()) == [1] * 10 + [3] * 10
    assert positions.test_subset(df, 4).count() == 8
    assert positions.test_subset(df, 3).count() == 9


def test_batch_numbers(spark):
    df = spark.range(0, 9).withColumnRenamed("id", "row_pos")
    got = [(r.batch, r.batch_idx) for r in positions.batch_numbers(df, 4).orderBy("row_pos").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]


def test_running_offsets(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([2, 0, 1, 3, 0, 5])], "row_pos long, n long")
    got = [r.offset for r in positions.running_offsets(df, ["row_pos"], "n", num_partitions=3)
           .orderBy("row_pos").collect()]
    assert got == [0, 2, 2, 3, 6, 6]


def test_file_positions_follow_file_order(spark):
    path = scratch_path(spark, "lines")
    df = spark.range(0, 5000).select(F.col("id").alias("row_pos"),
                                     F.concat(F.lit("k"), F.col("id").cast("string"), F.lit("\tv")).alias("line"))
    write_lines(df, path, num_partitions=6)
    back = read_tsv_lines(spark, path).collect()
    assert sorted((r.row_pos, r.key) for r in back) == [(i, f"k{i}") for i in range(5000)]


def test_file_positions_when_one_file_spans_many_splits(spark):
    import os

    from curatio.session import local_path
    from curatio.sources.files import read_json_splits

    root = scratch_path(spark, "bigfile")
    d = local_path(f"{root}/ds")
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/ds_train.json", "w") as f:
        for i in range(3000):
            f.write('{"v": "%d"}\n' % i)
    with open(f"{d}/ds_test.json", "w") as f:
        for i in range(500):
            f.write('{"v": "t%d"}\n' % i)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = read_json_splits(spark, root, "ds", "v string", ["train", "test"])
        assert df.rdd.getNumPartitions() > 10
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    train = sorted((r.row_pos, r.v) for r in rows if r.split == "train")
    assert train == [(i, str(i)) for i in range(3000)]
    test = sorted((r.row_pos, r.v) for r in rows if r.split == "test")
    assert test == [(i, f"t{i}") for i in range(500)]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_rows_leave_no_shuffle_files(spark):
    """Also a checkpoint and ordered lines; the files used to lie there until the driver collected its garbage."""
    import time
    before = _shuffle_files(spark)
    wide = spark.range(3000).select(((F.col("id") * 7) % 3000).alias("k"), F.array("id", "id").alias("points"))
    numbered = positions.dense_positions(wide, ["k"], "pos")
    kept = positions.dense_positions(wide, ["k"], "pos", keep=["points"])
    write_lines(numbered.select("pos", F.col("k").cast("string").alias("line")), scratch_path(spark, "lines"), order=["pos"])
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert kept.columns == ["points", "pos"]
    assert sorted((r.points[0] * 7 % 3000, r.pos) for r in kept.collect()) == [(i, i) for i in range(3000)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_scratch_that_passes_is_deleted(spark):
    import os

    from curatio.session import local_path, passing_scratch
    stays = scratch_path(spark, "stays")
    with pytest.raises(KeyError), passing_scratch(spark):
        passed = [scratch_path(spark, "passes")]
        with passing_scratch(spark):
            passed.append(scratch_path(spark, "inside"))
            for p in passed:
                spark.range(5).write.parquet(p)
            out = positions.stored(spark.read.parquet(passed[1]), "stays", stays)
        assert [os.path.exists(local_path(p)) for p in passed] == [True, False]
        raise KeyError
    assert not os.path.exists(local_path(passed[0])) and out.count() == 5
