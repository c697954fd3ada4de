"""Incremental parsing of model-output shards, with positions.

Two queries over the same files, each a Structured Streaming file source with a checkpoint
and an append sink, so that a file counts once however often a run is killed and restarted:

* ``parsed_output_stream``: the parsed outputs with their place in their file (stateless);
* ``shard_offset_stream``: the position at which each shard starts in its split.  The state of
  a split is the next shard number, the next position and the sizes of the shards that came
  too early (never their rows); a shard is let out when all shards before it are.

``positioned_outputs`` joins the two: rows of let-out shards, at the batch reader's positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from curatio.operators.parse import parse_outputs
from curatio.sources.files import PART_SHARD_RE
from curatio.sources.json_arrays import whole_strings

ON_DAMAGED = ("fail", "quarantine")
TRIGGER_BYTES = 256 << 20     # of text in one micro-batch, however many files that is
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _shard_files(spark: SparkSession, source_glob: str, path_re: str, on_damaged: str) -> DataFrame:
    """Streaming (split, shard, path, arr, damaged); each shard file is read whole."""
    if on_damaged not in ON_DAMAGED:
        raise ValueError(f"on_damaged must be one of {ON_DAMAGED}")
    raw = (spark.readStream.format("text").option("wholetext", True)
           .option("maxBytesPerTrigger", TRIGGER_BYTES).load(source_glob)).withColumn("path", F.col("_metadata.file_path"))
    array, reason = whole_strings("value")
    files = raw.select(F.regexp_extract("path", path_re, 1).alias("split"), F.regexp_extract("path", path_re, 2).cast("bigint").alias("shard"),
                       "path", array.alias("arr"), reason.alias("damaged"))
    if on_damaged == "fail":
        said = F.concat(F.lit("damaged shard "), F.col("path"), F.lit(": "), F.col("damaged"))
        files = files.where(F.when(F.col("damaged").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("damaged")
    return files


def parsed_output_stream(spark: SparkSession, source_glob: str, dataset: str, model: str,
                         path_re: str = PART_SHARD_RE, on_bad: str = "fail", on_damaged: str = "fail") -> DataFrame:
    """Streaming DataFrame of (split, shard, path, shard_idx, rationale, label).

    A file that is no array of strings stops the query before it is recorded as done.  With
    ``on_damaged="quarantine"`` it gives one row with NULL shard_idx and the reason in the column ``damaged``.
    """
    files = _shard_files(spark, source_glob, path_re, on_damaged)
    keep = [c for c in files.columns if c != "arr"]
    if on_damaged == "fail":
        rows = files.select(*keep, F.posexplode("arr").alias("shard_idx", "output"))
        return parse_outputs(rows, dataset, model, on_bad=on_bad).drop("output")
    whole = F.transform("arr", lambda x, i: F.struct(i.alias("shard_idx"), x.alias("output")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("shard_idx"), F.lit("").alias("output")))
    rows = files.select(*keep, F.inline(F.when(F.col("damaged").isNull(), whole).otherwise(none)))
    good = parse_outputs(rows.withColumn("output", F.when(F.col("damaged").isNull(), F.col("output"))), dataset, model,
                         on_bad="quarantine" if on_bad == "fail" else on_bad)
    return good.drop("output")


class ShardOrder(StatefulProcessor):
    """Lets the shards of a split out in the order of their numbers, from 0, with their start positions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "shard long, pos long")
        self.early = handle.getMapState("early", "shard long", "path string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, pos = self.next.get() if self.next.exists() else (0, 0)
        for pdf in rows:
            for shard, path, n in zip(pdf["shard"].tolist(), pdf["path"], pdf["n"].tolist(), strict=True):
                if shard < at or self.early.containsKey((shard,)):
                    raise ValueError(f"shard {shard} of split {key[0]!r} came twice: {path}")
                self.early.updateValue((shard,), (path, n))
        out = []
        while self.early.containsKey((at,)):
            path, n = self.early.getValue((at,))
            out.append((key[0], at, path, pos, n))
            self.early.removeKey((at,))
            at, pos = at + 1, pos + n
        self.next.update((at, pos))
        yield pd.DataFrame(out, columns=["split", "shard", "path", "base", "n"])

    def close(self) -> None:
        pass


def shard_offset_stream(spark: SparkSession, source_glob: str, path_re: str = PART_SHARD_RE, on_damaged: str = "fail") -> DataFrame:
    """Streaming (split, shard, path, base, n): where each shard starts, once all shards before it have come.

    Each number is one file, from 0 without gaps; a second file of a number stops the query.
    A damaged file in quarantine counts no rows.
    """
    files = _shard_files(spark, source_glob, path_re, on_damaged).select("split", "shard", "path", F.greatest(F.size("arr"), F.lit(0)).cast("bigint").alias("n"))
    return files.groupBy("split").transformWithStateInPandas(
        statefulProcessor=ShardOrder(), outputStructType="split string, shard long, path string, base long, n long", outputMode="Append", timeMode="None")


def run_available(stream: DataFrame, sink_path: str, checkpoint_path: str,
                  partition_by: tuple[str, ...] = ("split",)) -> StreamingQuery:
    """Process everything available now, append to parquet, and stop.

    The state store of stateful queries is RocksDB for the time of the run.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, _ROCKS)
    try:
        w = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint_path).option("path", sink_path)
             .trigger(availableNow=True))
        if partition_by:
            w = w.partitionBy(*partition_by)
        q = w.start()
        q.awaitTermination()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
    return q


def positioned_outputs(spark: SparkSession, rows_path: str, offsets_path: str, out_col: str = "row_pos") -> DataFrame:
    """The parsed rows of the shards let out so far, at their positions in their split."""
    offsets = spark.read.parquet(offsets_path).select("path", "base")
    return (spark.read.parquet(rows_path).join(offsets, "path")
            .withColumn(out_col, (F.col("base") + F.col("shard_idx")).cast("bigint")).drop("base"))
