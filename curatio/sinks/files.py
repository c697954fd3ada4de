"""File sinks.

Ordered line files are written as a folder of part files in range order: each writer task
takes a contiguous range of positions, so reading the parts in name order gives the lines
in order, and no task has to hold a whole output file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.operators.positions import materialize
from curatio.session import passing_shuffles


def ordered(df: DataFrame, order: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted: part files in name order hold the rows in order.

    Without an explicit count AQE may coalesce small ranges (they stay contiguous).
    """
    cols = [F.col(c) for c in order]
    r = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    return r.sortWithinPartitions(*cols)


def write_lines(df: DataFrame, path: str, line_col: str = "line", order: Sequence[str] = ("row_pos",),
                partition_by: Sequence[str] = (), mode: str = "overwrite",
                num_partitions: int | None = None) -> None:
    """Text lines in ``order``; with ``partition_by`` one folder per value (e.g. per annotator)."""
    o = ordered(df, [*partition_by, *order], num_partitions)
    w = o.select(*partition_by, line_col).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with passing_shuffles(df.sparkSession):
        w.text(path)


def write_json_splits(df: DataFrame, root: str, dataset: str, split_map: dict[str, str],
                      split_col: str = "split", order: Sequence[str] = ("row_pos",),
                      drop: Sequence[str] = ("row_pos",), num_partitions: int | None = None,
                      in_order: bool = False) -> list[str]:
    """Each split as JSON lines under its logical name: ``{root}/{dataset}/{dataset}_{name}.json``.

    ``split_map`` maps logical name → source split name (e.g. ``test`` → ``validation``).
    The rows are checkpointed once; each split (at most three) is then one write. Rows keep
    their order, and NULLs are written out.  With ``in_order`` the rows are stored already
    and the partitions, in turn, hold those of each split in order: they are written as they are.
    """
    if not split_map:
        raise ValueError("split_map (logical name -> source split) is required")
    if not in_order:
        df = materialize(df, "splits")
    out = []
    for logical, source in split_map.items():
        path = f"{root.rstrip('/')}/{dataset}/{dataset}_{logical}.json"
        part = df.where(F.col(split_col) == source)
        part = part if in_order else ordered(part, order, num_partitions)
        with passing_shuffles(df.sparkSession):
            part.drop(split_col, *drop).write.mode("overwrite").option("ignoreNullFields", False).json(path)
        out.append(path)
    return out


def write_output_shards(df: DataFrame, root: str, shard_size: int, output_col: str = "output",
                        split_col: str = "split", pos_col: str = "row_pos") -> None:
    """Model outputs as JSON arrays of strings, ``shard_size`` per file, by split and shard.

    Rows must carry dense positions per split.  A shard is bounded by ``shard_size``.
    """
    shard = F.floor(F.col(pos_col) / F.lit(shard_size)).cast("bigint")
    arrays = (df.withColumn("shard", shard)
              .groupBy(split_col, "shard")
              .agg(F.sort_array(F.collect_list(F.struct(pos_col, output_col))).alias("_s"))
              .select(split_col, "shard",
                      F.to_json(F.transform("_s", lambda x: x[output_col])).alias("value")))
    arrays.write.mode("overwrite").partitionBy(split_col, "shard").text(root)


def write_output_single(df: DataFrame, root: str, splits: Sequence[str], rows_per_file: int,
                        output_col: str = "output", split_col: str = "split", pos_col: str = "row_pos") -> None:
    """Model outputs in the one-file-per-split layout ``{root}/{split}.json`` (S04).

    ``{split}.json`` is a folder of part files in position order, each one JSON array of at
    most ``rows_per_file`` strings, so that no task holds a split.
    """
    arrays = (df.groupBy(split_col, F.floor(F.col(pos_col) / F.lit(rows_per_file)).alias("_chunk"))
              .agg(F.sort_array(F.collect_list(F.struct(pos_col, output_col))).alias("_s"))
              .select(split_col, "_chunk", F.to_json(F.transform("_s", lambda x: x[output_col])).alias("value")))
    for s in splits:
        (ordered(arrays.where(F.col(split_col) == s), ["_chunk"]).select("value")
         .write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{root.rstrip('/')}/{s}.json"))


def write_json_arrays(df: DataFrame, root: str, cols: Sequence[str], chunk_rows: int,
                      pos_col: str = "row_pos", compression: str = "none") -> None:
    """Rows as JSON arrays of objects, ``chunk_rows`` per file (``chunk=<i>`` folders), as text or compressed (``gzip``)."""
    chunk = F.floor(F.col(pos_col) / F.lit(chunk_rows)).cast("bigint")
    arrays = (df.withColumn("chunk", chunk)
              .groupBy("chunk")
              .agg(F.sort_array(F.collect_list(F.struct(pos_col, *cols))).alias("_s"))
              .select("chunk", F.to_json(F.transform("_s", lambda x: F.struct(*[x[c].alias(c) for c in cols])))
                      .alias("value")))
    with passing_shuffles(df.sparkSession):
        arrays.write.mode("overwrite").partitionBy("chunk").option("compression", compression).text(root)


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))


def write_doc_texts(df: DataFrame, path: str, doc_col: str = "doc", text_col: str = "text") -> None:
    """Whole extracted text of each document as a (doc, text) table; text kept byte for byte."""
    df.select(doc_col, text_col).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], num_buckets: int,
                   mode: str = "overwrite") -> None:
    """A table bucketed and sorted by its key (e.g. ``(split, row_pos)``).

    Two tables written this way with the same bucket count join on the key bucket by
    bucket: the positional attach (J01) of very large tables then reads co-located files
    and needs no shuffle.
    """
    (df.write.mode(mode).bucketBy(num_buckets, *keys).sortBy(*keys).saveAsTable(table))
