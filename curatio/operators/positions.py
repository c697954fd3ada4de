"""Dense row positions, block/batch numbers and prefix offsets.

No operator here uses an un-partitioned window over a big table.  A global order is
realised by range partitioning (which also splits a hot key over many tasks); each row's
position is ``rows in earlier partitions + index inside its partition``.  The per-partition
counts are a table with one row per partition, so its size is bounded by the partition
count and it is safe to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.session import ensure_checkpoint_dir, passing_shuffles, scratch_path

_LOW33 = (1 << 33) - 1
_MAX_BROADCAST_SPLITS = 1_000_000   # four numbers a split: 32 MB at the bound


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Reliable checkpoint of ``df`` into the shared ``spark.checkpoint.dir`` folder.

    Range partitioning samples its bounds with a seed tied to the RDD, so two branches of
    one plan that each recompute it can disagree, and a lost executor could recompute a
    partition differently.  Numbering from checkpointed data makes positions fixed data
    and cuts the lineage; the checkpoint keeps the range partitioning and sort order, so
    later operators on the same key need no new exchange.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)    # a plan of its own, as the setting holds for plans made under it


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a compact table below the shared checkpoint folder (or to ``path``), and read back.

    For wide or many rows: columns that hold sorted, repeated or small values take a fraction of a
    checkpoint's rows.  The partitions and their order aren't kept.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with passing_shuffles(spark):
        df.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _range_partitioned(df: DataFrame, order_cols: list[Column], num_partitions: int | None) -> DataFrame:
    """Range partitioning on the order into an explicit number of ranges.

    The count defaults to ``spark.sql.shuffle.partitions``: size it for the input (ranges
    of a few hundred MB).  An explicit count keeps AQE from merging ranges, so the
    checkpointed table keeps that parallelism for the stages that read it.  (Merged ranges
    would still be contiguous and in order, so positions would stay right either way.)
    """
    n = num_partitions or shuffle_partitions(df)
    return df.repartitionByRange(n, *order_cols)


def _add_partition_offsets(tagged: DataFrame, value_col: str | None, out_col: str) -> DataFrame:
    """Add ``out_col`` = total of ``value_col`` (or row count) over all earlier partitions.

    ``tagged`` is checkpointed data with a ``_pid`` column.  The per-partition totals form a
    table of one row per partition; its prefix sum is a window over that tiny table, and it
    is broadcast: its size is bounded by the partition count, not by the data.
    """
    agg = F.count(F.lit(1)) if value_col is None else F.sum(value_col)
    totals = tagged.groupBy("_pid").agg(agg.alias("_t"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", F.coalesce(F.sum("_t").over(w), F.lit(0)).cast("bigint").alias(out_col))
    return tagged.join(F.broadcast(offs), "_pid")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def dense_positions(df: DataFrame, order: Sequence, out_col: str = "row_pos",
                    num_partitions: int | None = None, keep_partition: str | None = None,
                    range_id: Column | None = None, order_values: dict[str, Column] | None = None,
                    keep: Sequence[str] | None = None) -> DataFrame:
    """``row_number() over (order by ...) - 1`` without a single-partition window.

    ``order`` should be a total order (unique key) for reproducible positions; ties get
    distinct positions in an unspecified order.  ``keep_partition`` names a column that
    keeps the number of the row's range.  Where the ranges are known beforehand (a hash),
    ``range_id`` gives the row's, from 0 below ``num_partitions`` and rising with the order: the
    rows are then read once, without sampling the bounds, and ``order_values`` gives columns of the
    order that are made after the rows are dealt out, and aren't kept.  The result's partitions, in turn,
    hold the rows in order, unless ``keep`` names the columns of the result besides ``out_col``, which are
    then ``stored``.
    """
    order_cols = _cols(order)
    n = num_partitions or shuffle_partitions(df)
    ranges = _range_partitioned(df, order_cols, n) if range_id is None else df.repartitionById(n, range_id)
    made = order_values or {}
    s = (ranges.withColumns(made).sortWithinPartitions(*order_cols).drop(*made)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_loc", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    s = materialize(s, "positions") if keep is None else stored(s.select(*keep, "_pid", "_loc"), "positions")
    s = _add_partition_offsets(s, None, "_off")
    s = s.withColumn(out_col, (F.col("_off") + F.col("_loc")).cast("bigint")).drop("_loc", "_off")
    return s.withColumnRenamed("_pid", keep_partition) if keep_partition else s.drop("_pid")


def group_positions(df: DataFrame, keys: Sequence[str], order: Sequence, out_col: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by ...) - 1``, safe under a hot key.

    Global positions over (keys, order) minus the first position of each key.  Rows get that
    by (range partition, key), so a key holding a third of the rows stays spread over the
    partitions of its range; the keys of a partition form a table of one row each.
    """
    g = dense_positions(df, [*keys, *order], "_gpos", num_partitions, keep_partition="_rp")
    seg = g.groupBy("_rp", *keys).agg(F.min("_gpos").alias("_f"))
    first = seg.groupBy(*keys).agg(F.min("_f").alias("_first"))
    seg = seg.join(first, list(keys)).select("_rp", *keys, "_first")
    return (g.join(seg, ["_rp", *keys])
            .withColumn(out_col, (F.col("_gpos") - F.col("_first")).cast("bigint"))
            .drop("_rp", "_gpos", "_first"))


def group_offsets(df: DataFrame, keys: Sequence[str], order: Sequence, value_col: str,
                  out_col: str = "offset") -> DataFrame:
    """Exclusive prefix sum of ``value_col`` in ``order`` that restarts for each key."""
    r = running_offsets(df, [*keys, *order], value_col, "_run" if keys else out_col)
    if not keys:
        return r
    first = r.groupBy(*keys).agg(F.min("_run").alias("_start"))
    return (r.join(first, list(keys)).withColumn(out_col, (F.col("_run") - F.col("_start")).cast("bigint"))
            .drop("_run", "_start"))


def file_positions(df: DataFrame, out_col: str = "row_pos", group_cols: Sequence[str] = (),
                   order_prefix: Sequence = (), path_groups: dict[str, str] | None = None) -> DataFrame:
    """Positions in file order (file path, then byte offset, then line order).

    ``df`` must come straight from a file scan, so a partition always holds the same file
    splits in the same order: the count branch and the numbering branch agree.  Spark packs
    splits by size, not by name, so partition order alone is not file order.  Positions
    restart for each ``group_cols`` value (for example a split name); ``order_prefix``
    columns sort before the file path (for example a shard number).  ``path_groups`` (column ->
    pattern) are further groups, each the pattern's first capture in the file path, looked for
    once a split and not in every row.

    A row finds its split by its scan partition and its index there.  The table of splits
    is counted: up to ``_MAX_BROADCAST_SPLITS`` rows of four numbers it is broadcast, beyond
    that the join is a shuffle on the scan partition, which holds a bounded number of rows.
    """
    s = (df.withColumn("_scan", F.spark_partition_id())
         .withColumn("_loc", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    blocks = (s.withColumn("_path", F.col("_metadata.file_path")).withColumn("_blk", F.col("_metadata.file_block_start"))
              .groupBy(*group_cols, *_names(order_prefix), "_path", "_blk", "_scan")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_first")))
    found = {c: F.regexp_extract("_path", p, 1) for c, p in (path_groups or {}).items()}
    offs = materialize(group_offsets(blocks.withColumns(found) if found else blocks, [*group_cols, *found], [*order_prefix, "_path", "_blk"], "_n", "_off")
                       .select("_scan", "_first", "_n", "_off", *found), "splits")
    if offs.count() <= _MAX_BROADCAST_SPLITS:
        offs = F.broadcast(offs)
    o = offs.withColumnRenamed("_scan", "_of")
    inside = (F.col("_scan") == F.col("_of")) & (F.col("_loc") >= F.col("_first")) & (F.col("_loc") < F.col("_first") + F.col("_n"))
    return (s.join(o, inside)
            .withColumn(out_col, (F.col("_off") + F.col("_loc") - F.col("_first")).cast("bigint"))
            .drop("_scan", "_of", "_loc", "_first", "_n", "_off"))


def _names(cols) -> list[str]:
    return [c for c in cols if isinstance(c, str)]


def equal_blocks(df: DataFrame, k: int, pos_col: str = "row_pos", out_col: str = "block",
                 total: Column | None = None) -> DataFrame:
    """Near-equal contiguous blocks ``pos * k // n`` (not ``ntile``: sizes differ).

    ``total`` is the row count where it is known more cheaply than by counting ``df``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    n = df.select(F.count(F.lit(1))).scalar() if total is None else total
    return df.withColumn(out_col, F.floor((F.col(pos_col) * F.lit(k)) / n).cast("bigint"))


def batch_numbers(df: DataFrame, batch_size: int, pos_col: str = "row_pos",
                  batch_col: str = "batch", idx_col: str = "batch_idx") -> DataFrame:
    """Fixed-size batch number and index inside the batch."""
    b = F.lit(batch_size).cast("bigint")
    return (df.withColumn(batch_col, F.floor(F.col(pos_col) / b).cast("bigint"))
            .withColumn(idx_col, F.pmod(F.col(pos_col), b).cast("bigint")))


def batch_subset(df: DataFrame, batch_size: int, batch_idxs: Sequence[int],
                 pos_col: str = "row_pos") -> DataFrame:
    """Keep rows whose position is in the listed batches ``[i*b, (i+1)*b)``.

    A contiguous list from 0 becomes ``pos < k*b`` so parquet min/max statistics prune.
    """
    idxs = sorted(set(int(i) for i in batch_idxs))
    if not idxs:
        return df.limit(0)
    if idxs == list(range(idxs[-1] + 1)):
        return df.filter(F.col(pos_col) < F.lit(len(idxs) * batch_size))
    return df.filter(F.floor(F.col(pos_col) / F.lit(batch_size)).cast("bigint").isin(idxs))


def test_subset(df: DataFrame, batch_size: int, min_items: int = 8, pos_col: str = "row_pos") -> DataFrame:
    """Test mode of the page pipeline: stop after the first batch whose end reaches ``min_items``."""
    keep = math.ceil(min_items / batch_size) * batch_size
    return df.filter(F.col(pos_col) < F.lit(keep))


def running_offsets(df: DataFrame, order: Sequence, value_col: str, out_col: str = "offset",
                    num_partitions: int | None = None) -> DataFrame:
    """Sum of ``value_col`` over all earlier rows in ``order`` (exclusive prefix sum).

    Range partition (a hot key is split), a window inside each range partition (bounded
    size), and the totals of earlier partitions; no single-partition window over the rows.
    """
    order_cols = _cols(order)
    s = materialize(_range_partitioned(df, order_cols, num_partitions).sortWithinPartitions(*order_cols)
                    .withColumn("_pid", F.spark_partition_id()), "offsets")
    s = _add_partition_offsets(s, value_col, "_poff")
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return (s.withColumn("_loff", F.coalesce(F.sum(value_col).over(w), F.lit(0)))
            .withColumn(out_col, (F.col("_poff") + F.col("_loff")).cast("bigint"))
            .drop("_pid", "_loff", "_poff"))
