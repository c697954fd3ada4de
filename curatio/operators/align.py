"""Positional alignment and concatenation.

The reference attaches columns by list position.  Here position is an explicit key made at
ingest, so "attach" is an equi-join on (split, row_pos).  The length check makes it a full
outer join, which Spark always runs as a shuffle join; sides stored bucketed by the key need
no exchange (``sinks.write_bucketed``).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.operators.positions import dense_positions


def _fail_when(df: DataFrame, bad, message: str) -> DataFrame:
    """Keep every row; stop the job on the first row where ``bad`` holds."""
    return df.filter(F.when(bad, F.raise_error(F.lit(message))).isNull())


def attach_by_position(base: DataFrame, extra: DataFrame, keys: Sequence[str] = ("split", "row_pos"),
                       check: bool = True) -> DataFrame:
    """Add ``extra``'s columns to ``base`` row by row.

    Unequal lengths are an error, as in the reference: a full outer join on the position
    key, and any row present on one side only stops the job.  ``check=False`` makes it an
    inner join.
    """
    keys = list(keys)
    if not check:
        return base.join(extra, keys, "inner")
    b = base.withColumn("_in_base", F.lit(True))
    e = extra.withColumn("_in_extra", F.lit(True))
    j = b.join(e, keys, "full_outer")
    j = _fail_when(j, F.col("_in_base").isNull() | F.col("_in_extra").isNull(),
                   "attached column and table differ in length (position without a partner)")
    return j.drop("_in_base", "_in_extra")


def zip_by_position(frames: Sequence[DataFrame], key: str = "row_pos", check: bool = True) -> DataFrame:
    """Zip several equally long tables on their position (the reference's three-way zip).

    One exchange for all: the tables' rows, tagged with their side, meet by position, and one
    aggregate puts them side by side and counts them.  A position that a table lacks or has
    twice stops the job; without ``check`` a position that a table lacks is left out.
    """
    sides = []
    for i, f in enumerate(frames):
        own = [c for c in f.columns if c != key]
        sides.append(f.select(key, *[(F.struct(*own) if j == i else F.lit(None)).alias(f"_s{j}") for j in range(len(frames))]))
    types = [f.schema[f"_s{i}"].dataType for i, f in enumerate(sides)]
    rows = None
    for f in sides:
        f = f.select(key, *[F.col(f"_s{j}").cast(t).alias(f"_s{j}") for j, t in enumerate(types)])
        rows = f if rows is None else rows.unionByName(f)
    names = range(len(frames))
    met = rows.groupBy(key).agg(*[F.first(f"_s{j}", ignorenulls=True).alias(f"_s{j}") for j in names], *[F.count(f"_s{j}").alias(f"_n{j}") for j in names])
    if check:
        odd = functools.reduce(lambda a, b: a | b, [F.col(f"_n{j}") != 1 for j in names])
        met = _fail_when(met, odd, "zipped tables differ in length (position without a partner)")
    else:
        met = met.where(functools.reduce(lambda a, b: a & b, [F.col(f"_n{j}") > 0 for j in names]))
    return met.select(key, *[f"_s{j}.*" for j in names])


def union_rebased(frames: Sequence[DataFrame], pos_col: str = "row_pos", dense: bool = False,
                  source_col: str = "source_order") -> DataFrame:
    """Concatenate tables in order; positions continue from the previous table.

    Each table's positions are first made dense (0..n-1) unless ``dense``; the offset of
    table i is the row count of tables before it (scalar subqueries, one number each).
    """
    out = None
    offset = F.lit(0).cast("bigint")
    for i, f in enumerate(frames):
        r = f if dense else dense_positions(f.withColumnRenamed(pos_col, "_orig_pos"), ["_orig_pos"], pos_col) \
            .drop("_orig_pos")
        rows = r.select(F.count(F.lit(1))).scalar()     # of the checkpointed positions, unless ``dense``
        r = r.withColumn(pos_col, (offset + F.col(pos_col)).cast("bigint")).withColumn(source_col, F.lit(i))
        out = r if out is None else out.unionByName(r)
        offset = offset + rows
    return out


def assemble_splits(parts: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Named splits → one table with a ``split`` column."""
    out = None
    for name, f in parts.items():
        r = f.withColumn(split_col, F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out
