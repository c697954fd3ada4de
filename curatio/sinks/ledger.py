"""Appending ordered lines batch by batch, once each.

A batch is staged as part files in a folder of its own; then one small ledger entry names the
batch, its folder and its row count.  Writing the entry is the commit: readers see the folders
that the ledger names and nothing else.  So a batch that fails half way leaves no line behind,
and a batch that is already in the ledger isn't written again.  An entry is one Spark write,
whose output appears by a rename when its job commits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.operators.positions import file_positions
from curatio.sinks.files import write_lines

_ENTRY = "batch long, folder string, n_lines long"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(batch, folder, n_lines) of the committed batches."""
    try:
        found = spark.read.schema(_ENTRY).json(f"{root.rstrip('/')}/ledger/batch=*/part-*")
        return found.select("batch", "folder", "n_lines")
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def stage_lines(lines: DataFrame, root: str, batch: int, line_col: str = "line", order: Sequence[str] = ("row_pos",)) -> str:
    """The batch's lines as part files in order, in a new folder that no reader sees yet; returns its name."""
    folder = f"batch{int(batch):012d}-{uuid.uuid4().hex[:12]}"
    write_lines(lines, f"{root.rstrip('/')}/data/{folder}", line_col, order)
    return folder


def commit(spark: SparkSession, root: str, batch: int, folder: str) -> None:
    """Enters a staged folder into the ledger; from then on readers see its lines."""
    n = spark.read.text(f"{root.rstrip('/')}/data/{folder}").count()
    entry = spark.createDataFrame([(int(batch), folder, n)], _ENTRY).coalesce(1)
    entry.write.mode("overwrite").json(f"{root.rstrip('/')}/ledger/batch={int(batch):012d}")


def append_lines(lines: DataFrame, root: str, batch: int, line_col: str = "line", order: Sequence[str] = ("row_pos",)) -> bool:
    """Appends a batch of lines; False if the ledger has that batch already, and nothing is written.

    One writer at a time may write a batch; different batches don't meet.
    """
    spark = lines.sparkSession
    if not ledger(spark, root).where(F.col("batch") == int(batch)).isEmpty():
        return False
    commit(spark, root, batch, stage_lines(lines, root, batch, line_col, order))
    return True


def read_appended(spark: SparkSession, root: str) -> DataFrame:
    """(batch, line_pos, line) of all committed lines, in batch order, then line order."""
    folders = [r.folder for r in ledger(spark, root).collect()]      # a listing of folders, as of files
    if not folders:
        return spark.createDataFrame([], "batch long, line_pos long, line string")
    df = spark.read.text([f"{root.rstrip('/')}/data/{f}" for f in folders])
    df = df.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), re.escape("/data/batch") + r"([0-9]+)-", 1).cast("bigint"))
    return file_positions(df, "line_pos", order_prefix=["batch"]).select("batch", "line_pos", F.col("value").alias("line"))
