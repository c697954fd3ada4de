"""Exact-size seeded splits and subsamples.

Deterministic per seed, disjoint, covering, exact size.  Rows are ordered by
``md5(seed ':' row_pos)`` (then row_pos); the first ``n_test`` form the held-out part.  Which
hash stands at the cut is found by counting, not by sorting: a histogram of the leading 16 bits
of the hash names the bucket that holds the cut, the next 16 bits are counted only inside that
bucket, and so on until the bucket is small.  The split is then one filter over the
rows: no sort, no range partitioning, no global ``limit``.

The rows are read a few times, only their positions but for the last.  A ``stored`` input (a table
on disk, a checkpoint) is read as it is; any other runs once, into a scratch table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.operators.positions import dense_positions, materialize, shuffle_partitions
from curatio.session import scratch_path

DIGITS = 4              # hexadecimal digits of the hash counted at a time: 65,536 buckets
SMALL_BUCKET = 4096     # rows of the bucket of the cut that are looked at one by one


def _hash(seed: int, pos_col: str) -> Column:
    return F.md5(F.concat(F.lit(str(int(seed))), F.lit(":"), F.col(pos_col).cast("string")))


def hash_cut(keys: DataFrame, seed: int, count: int, pos_col: str = "row_pos", small: int = SMALL_BUCKET) -> tuple[str, int]:
    """(hash, position) of the ``count``-th row of ``keys`` (stored positions, unique) in hash order."""
    hashed = keys.select(_hash(seed, pos_col).alias("h"), F.col(pos_col).cast("bigint").alias("p"))
    prefix, need = "", count
    while True:
        inside = hashed.where(F.col("h").startswith(prefix))
        counted = inside.groupBy(F.substring("h", 1, len(prefix) + DIGITS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))      # at most 65,536 rows
        bucket = counted.select("b", "n", upto.alias("upto")).where(F.col("upto") >= need).orderBy("b").first()
        need -= bucket.upto - bucket.n
        prefix = bucket.b
        if bucket.n <= small or len(prefix) == 32:
            row = hashed.where(F.col("h").startswith(prefix)).orderBy("h", "p").limit(need).orderBy(F.desc("h"), F.desc("p")).first()
            return row.h, row.p


def _stored(df: DataFrame, stored: bool) -> DataFrame:
    if stored:
        return df
    path = scratch_path(df.sparkSession, "sampled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(df: DataFrame, seed: int, test_size: float | int, pos_col: str = "row_pos", among: Column | None = None) -> Column:
    """True for the held-out rows of ``df``, a stored table (or of those for which ``among`` holds); never NULL.

    A float ``test_size`` takes ``ceil(test_size * n)`` rows, an int that many rows.
    """
    if isinstance(test_size, float) and not 0.0 < test_size < 1.0:
        raise ValueError("a fractional test_size must lie in (0, 1)")
    chosen = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    keys = materialize(df.where(chosen).select(pos_col), "sampling-keys")
    n = keys.count()
    count = math.ceil(test_size * n) if isinstance(test_size, float) else int(test_size)
    if count <= 0 or n == 0:
        return F.lit(False)
    if count >= n:
        return chosen
    h, p = hash_cut(keys, seed, count, pos_col)
    mine = _hash(seed, pos_col)
    return F.coalesce(chosen & ((mine < h) | ((mine == h) & (F.col(pos_col) <= p))), F.lit(False))


def seeded_rank(df: DataFrame, seed: int, pos_col: str = "row_pos", out_col: str = "_rank") -> DataFrame:
    """Rank of every row by the seeded hash, for a whole permutation; the partitions, in turn, hold the rows by rank.

    The leading 32 bits of the hash say which of the equal ranges a row belongs to; the hash itself is
    made again there, for the sorting, and is neither shuffled nor stored.
    """
    n = shuffle_partitions(df)
    lead = F.conv(F.substring(_hash(seed, pos_col), 1, 8), 16, 10).cast("bigint")
    part = F.coalesce(F.shiftright(lead * F.lit(n), 32), F.lit(0)).cast("int")      # a NULL position has no hash and is first
    return dense_positions(df, ["_h", pos_col], out_col, n, range_id=part, order_values={"_h": _hash(seed, pos_col)})


def exact_split(df: DataFrame, seed: int, test_size: float | int, pos_col: str = "row_pos",
                out_col: str = "part", test_name: str = "test", train_name: str = "train", stored: bool = False) -> DataFrame:
    """Label each row ``test``/``train``; sizes as in ``held_out``."""
    df = _stored(df, stored)
    out = held_out(df, seed, test_size, pos_col)
    return df.withColumn(out_col, F.when(out, F.lit(test_name)).otherwise(F.lit(train_name)))


def subsample(df: DataFrame, fraction: float, seed: int, pos_col: str = "row_pos", stored: bool = False) -> DataFrame:
    """Keep the train part of a ``1 - fraction`` held-out split (``fraction < 1``)."""
    if fraction >= 1.0:
        return df
    s = exact_split(df, seed, 1.0 - fraction, pos_col, "_part", stored=stored)
    return s.where(F.col("_part") == "train").drop("_part")


def subsample_train(df: DataFrame, fraction: float, seed: int, split_col: str = "split",
                    pos_col: str = "row_pos", stored: bool = False) -> DataFrame:
    """``subsample`` of the train split inside a table of all splits."""
    if fraction >= 1.0:
        return df
    df = _stored(df, stored)
    return df.where(~held_out(df, seed, 1.0 - fraction, pos_col, F.col(split_col) == "train"))


def carve_valid(df: DataFrame, seed: int = 0, valid_size: float = 0.1, split_col: str = "split",
                pos_col: str = "row_pos", stored: bool = False) -> DataFrame:
    """Move a seeded ``valid_size`` share of the train split to ``valid``; other splits unchanged."""
    df = _stored(df, stored)
    moved = held_out(df, seed, valid_size, pos_col, F.col(split_col) == "train")
    return df.withColumn(split_col, F.when(moved, F.lit("valid")).otherwise(F.col(split_col)))


def permute_head_split(df: DataFrame, head: int = 800, seed: int = 0, pos_col: str = "row_pos",
                       split_col: str = "split") -> DataFrame:
    """First ``head`` rows of a seeded permutation are train, the rest test.

    ``pos_col`` becomes the row's place in the permutation within its split, which is the
    order the splits are written in, and the order of the rows over the partitions.
    """
    r = seeded_rank(df, seed, pos_col)
    in_head = F.col("_rank") < F.lit(head)
    return (r.withColumn(split_col, F.when(in_head, F.lit("train")).otherwise(F.lit("test")))
            .withColumn(pos_col, F.when(in_head, F.col("_rank")).otherwise(F.col("_rank") - F.lit(head)).cast("bigint"))
            .drop("_rank"))
