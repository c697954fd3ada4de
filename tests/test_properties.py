"""Property tests: exact splits, near-equal ordered blocks, dense positions."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatio.operators import positions, sampling

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(n=st.integers(1, 80), frac=st.floats(0.05, 0.95), seed=st.integers(0, 10_000))
def test_split_exact_for_any_seed(spark, n, frac, seed):
    df = spark.range(n).withColumnRenamed("id", "row_pos")
    rows = sampling.exact_split(df, seed, frac).collect()
    test = sorted(r.row_pos for r in rows if r.part == "test")
    assert len(test) == math.ceil(frac * n) and len(rows) == n
    assert len({r.row_pos for r in rows}) == n


@SETTINGS
@given(n=st.integers(1, 60), k=st.integers(1, 9))
def test_blocks_near_equal_and_ordered(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "row_pos")
    blocks = [r.block for r in positions.equal_blocks(df, k).orderBy("row_pos").collect()]
    assert blocks == sorted(blocks)                       # contiguous, order-preserving
    sizes = [blocks.count(b) for b in set(blocks)]
    assert max(sizes) - min(sizes) <= 1 and len(set(blocks)) == min(n, k)


@SETTINGS
@given(n=st.integers(1, 300), parts=st.integers(1, 6), hot=st.booleans())
def test_positions_dense_under_any_partitioning(spark, n, parts, hot):
    key = F.lit(0) if hot else (F.col("id") % 7)
    df = spark.range(n).select(key.alias("g"), F.col("id")).repartition(parts)
    got = positions.group_positions(df, ["g"], ["id"], "pos", num_partitions=4).collect()
    for g in {r.g for r in got}:
        ids = sorted((r.id, r.pos) for r in got if r.g == g)
        assert [p for _, p in ids] == list(range(len(ids)))
