"""File sources with stable row positions.

Positions follow file order: file path, then the byte offset of the split, then the line
(or array element) inside it - never Spark's partition order, which packs splits by size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.operators.positions import file_positions, group_offsets, materialize
from curatio.sources.json_arrays import ArrayFiles, as_rows, as_strings, refuse, scan_arrays, with_object

SPLIT_FILE_RE = r"_(train|valid|test)\.json(/|$)"
COT_SHARD_RE = r"(?:^|/)(train|valid|test)_CoT_([0-9]+)\.json(?:/[^/]*)?$"
PART_SHARD_RE = r"/split=(train|valid|test)/shard=([0-9]+)/"
SINGLE_RE = r"/(train|valid|test)\.json(?:/[^/]*)?$"
_MAX_BROADCAST_FILES = 100_000     # a path and a number a file: about 20 MB at the bound


def read_json_splits(spark: SparkSession, root: str, dataset: str, schema: str, splits: Sequence[str] = ("train", "test"),
                     required: Sequence[str] | None = None, quarantine: str | None = None) -> DataFrame:
    """``{root}/{dataset}/{dataset}_{split}.json`` (JSON lines) → one table with ``split`` and ``row_pos``.

    The schema (DDL) is declared, without an inference pass; positions restart at 0 in each
    split; blank lines are no rows.  A line that is no JSON object, doesn't fit the schema or lacks
    one of the ``required`` columns (all of the schema, unless given) stops the job.  With
    ``quarantine`` it keeps its position with NULL columns, and (path, place, reason, line) is
    written to that folder.
    """
    paths = [f"{root.rstrip('/')}/{dataset}/{dataset}_{s}.json" for s in splits]
    names = T._parse_datatype_string(schema).names
    lines = spark.read.text(paths).where(F.col("value").startswith("{") | ~F.col("value").rlike(r"\A\s*\z"))
    lines = file_positions(lines.withColumn("_path", F.col("_metadata.file_path")), "row_pos", path_groups={"split": SPLIT_FILE_RE})
    df = with_object(lines.select("split", "row_pos", "value", "_path"), "value", schema, names if required is None else required)
    if quarantine is not None:
        (df.where("_why IS NOT NULL").selectExpr("_path AS path", "row_pos AS place", "_why AS reason", "value AS line")
         .write.mode("overwrite").parquet(quarantine))
    else:
        said = F.concat(F.lit("damaged line "), F.col("row_pos").cast("string"), F.lit(" of "), F.col("_path"), F.lit(": "), F.col("_why"))
        df = df.where(F.when(F.col("_why").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    return df.select(*[F.col("_r")[c].alias(c) for c in names], "split", "row_pos")


def _accepted(files: ArrayFiles, quarantine: str | None, what: str) -> DataFrame:
    """The elements; problems stop the job or are written to the folder ``quarantine``."""
    if quarantine is None:
        refuse(files.problems, what)
    else:
        files.problems.write.mode("overwrite").parquet(quarantine)
    return files.elements


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: str, path_order_re: str | None = None,
                    required: Sequence[str] | None = None, quarantine: str | None = None) -> DataFrame:
    """Files each holding one JSON array of objects → rows in file then array order.

    ``path_order_re`` captures a number in the file path that orders files (e.g. a chunk
    number); otherwise files are ordered by path.  A file of any size is read by as many
    tasks as it has byte ranges (see ``json_arrays``).  Damaged files and elements, and elements
    without a ``required`` column (all of the schema, unless given), stop the job.  With
    ``quarantine`` (path, place, reason) is written to that folder; such an element keeps its position
    with NULL columns, a damaged file gives no rows.
    """
    names = T._parse_datatype_string(schema).names
    rows = _accepted(as_rows(scan_arrays(spark, paths), schema, names if required is None else required), quarantine, "damaged array files")
    order = F.regexp_extract("path", path_order_re, 1).cast("bigint") if path_order_re else F.lit(0).cast("bigint")
    rows = rows.select("path", F.col("idx").alias("shard_idx"), *names)
    return shard_positions(rows, F.lit(""), order).select(*names, "row_pos")


def read_output_arrays(spark: SparkSession, paths: str | Sequence[str], path_re: str = COT_SHARD_RE,
                       has_shard: bool = True, quarantine: str | None = None) -> DataFrame:
    """Files each holding a JSON array of strings → (split, shard, row_pos, output).

    ``path_re`` captures the split name and (when ``has_shard``) the shard number from the
    file path.  Positions run over shards in numeric order (then path), then array order,
    restarting per split.  A file of any size is read by as many tasks as it has byte ranges
    (see ``json_arrays``).  A damaged file or an element that is no string stops the job, as later
    rows would move up; with ``quarantine`` (path, place, reason) is written to that folder,
    such an element keeps its position with a NULL output, and a damaged file gives no rows.
    """
    files = _accepted(as_strings(scan_arrays(spark, paths)), quarantine, "damaged output files")
    shard = F.regexp_extract("path", path_re, 2).cast("bigint") if has_shard else F.lit(0).cast("bigint")
    rows = files.select("path", F.col("idx").alias("shard_idx"), "output")
    return shard_positions(rows, F.regexp_extract("path", path_re, 1), shard).select("split", "shard", "row_pos", "output")


def shard_positions(rows: DataFrame, split: Column | None = None, shard: Column | None = None, out_col: str = "row_pos") -> DataFrame:
    """Positions of (split, shard, path, shard_idx) rows from the row counts of the files.

    Files follow each other in shard order (then path) and may hold any number of rows.
    ``split`` and ``shard``, if given, are derived from ``path``, once a file; the rows needn't have them.
    The table of files is counted: it is broadcast up to ``_MAX_BROADCAST_FILES`` rows, and
    beyond that AQE picks the join.
    """
    if split is None:
        sizes = rows.groupBy("split", "shard", "path").agg(F.count(F.lit(1)).alias("_n"))
        named = []
    else:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).select(split.alias("split"), shard.alias("shard"), "path", "_n")
        named = ["split", "shard"]
    offs = materialize(group_offsets(sizes, ["split"], ["shard", "path"], "_n", "_off").select("path", "_off", *named), "files")
    if offs.count() <= _MAX_BROADCAST_FILES:
        offs = F.broadcast(offs)
    return (rows.join(offs, "path")
            .withColumn(out_col, (F.col("_off") + F.col("shard_idx")).cast("bigint")).drop("_off"))


def read_tsv_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Two-column tab-separated lines in file order → (row_pos, key, rest); rest NULL without a tab."""
    df = spark.read.text(paths)
    df = file_positions(df, "row_pos")
    parts = F.split("value", "\t", 2)
    return df.select("row_pos", F.get(parts, 0).alias("key"), F.get(parts, 1).alias("rest"))


def list_files(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """File listing as a table of paths; file contents are never read (column pruned)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.load(folder).select("path", "length", "modificationTime")
