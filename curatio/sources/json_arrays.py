"""Files that each hold one JSON array, read by many tasks.

A JSON array has no line ends to cut at, and whether a comma stands between two elements
depends on all the text before it.  The text source splits a file at commas, wherever they
are, into byte ranges that are read at the same time.  What a piece of text does to the
state (inside a string or not, nesting depth) is a small function of the state at its start:

* inside a string or not: changed by an odd number of quotes that aren't escaped (an escape never spans a
  comma, so pieces can be looked at one by one);
* depth: plus the opening, minus the closing brackets outside strings, which are one half of
  the parts between quotes or the other.

So every byte range of a file that has several gives one row: its function for both starts.  The
functions are composed by a prefix sum over the ranges of a file (a row per range), which says in
what state each range starts; a file's first range starts outside.  Then every comma at depth 1
outside strings ends an element, which a second reading finds in file order, range by range:
the text is never shuffled, and the path is stored per element, not per piece.  Only the elements
at the ends of ranges, two a range at most, are put together by (file, element number).

No task holds more than one byte range or one element.  Nothing is lost silently: a file that
is empty, cut off, no array, or followed by other text, and an element that is no JSON value,
are reported with the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatio.operators.positions import materialize
from curatio.session import scratch_path

_ESCAPE = r"(?s)\\."
_STRING = r'"[^"]*("|\z)'
_MAX_BROADCAST_RANGES = 100_000     # a path and three numbers a range: about 25 MB at the bound
_QUOTE, _OPEN, _CLOSE, _BACKSLASH = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _c, _k in (('"', _QUOTE), ("[", _OPEN), ("{", _OPEN), ("]", _CLOSE), ("}", _CLOSE), ("\\", _BACKSLASH)):
    _KIND[ord(_c)] = _k


class DamagedInput(ValueError):
    """Input that the readers refuse; the message lists the first problems."""


def refuse(problems: DataFrame, what: str) -> None:
    """Stops with the first of ``problems`` (path, place, reason), if there are any."""
    first = problems.orderBy("path", "place").limit(5).collect()
    if first:
        raise DamagedInput(f"{what}: " + "; ".join(f"{r.path} at {r.place}: {r.reason}" if r.place is not None else f"{r.path}: {r.reason}"
                                                    for r in first))


@dataclass
class ArrayFiles:
    elements: DataFrame     # path, idx, text, ok, two: the JSON text of each element of the readable files, whether it is one value, or has an opening bracket after a closing one
    damaged: DataFrame      # path, place (NULL: the whole file), reason: files that can't be read
    problems: DataFrame     # the same of files and elements


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"([0-9]+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def _same_ranges(spark: SparkSession):
    """Within it, every scan of the same files cuts them at the same places, though executors may come and go."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _marks(value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the pieces in their joined bytes; places and kinds of the quotes and brackets that aren't escaped."""
    _, offsets, data = value.buffers()
    offsets = np.frombuffer(offsets, np.int64)[value.offset:value.offset + len(value) + 1]
    if data is None or offsets[0] == offsets[-1]:
        return offsets[1:] - offsets[0], np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = _KIND[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]]
    ends, at = offsets[1:] - offsets[0], np.flatnonzero(kind)
    kind = kind[at]
    slash = at[kind == _BACKSLASH]
    if len(slash):
        piece = np.searchsorted(ends, slash, "right")
        new = np.concatenate([[True], (slash[1:] != slash[:-1] + 1) | (piece[1:] != piece[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(slash)))
        last = first + count - 1
        escaped = (slash[last] + 1)[(count % 2 == 1) & (slash[last] + 1 < ends[piece[last]])]
        keep = (kind != _BACKSLASH) & ~np.isin(at, escaped)
        at, kind = at[keep], kind[keep]
    return ends, at, kind


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """The rows [a, b) of each byte range in a batch of (path, blk, ...)."""
    path = pc.dictionary_encode(batch.column(0)).indices.to_numpy(zero_copy_only=False)
    blk = batch.column(1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((path[1:] != path[:-1]) | (blk[1:] != blk[:-1])) + 1).tolist(), len(path)]
    return zip(cuts[:-1], cuts[1:], strict=True) if len(path) else iter(())


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each byte range: what it does to the state, from outside a string (d0) and from inside one (d1)."""
    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("path", "blk", "odd", "d0", "d1"), (*key, odd, *d), strict=True))], _EFFECTS)
    key, odd, d = None, 0, [0, 0]
    for batch in batches:
        value = batch.column(2).cast(pa.large_string())
        for a, b in _runs(batch):
            here = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            if here != key:
                if key is not None:
                    yield row()
                key, odd, d = here, 0, [0, 0]
            _, _, kind = _marks(value.slice(a, b - a))
            inside = (odd + np.cumsum(kind == _QUOTE)) & 1
            step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
            d = [d[i] + int(step[inside == i].sum()) for i in (0, 1)]
            odd = int(inside[-1]) if len(inside) else odd
    if key is not None:
        yield row()


class _Range:
    """The state in a byte range, and the pieces of the element that hasn't ended."""

    def __init__(self, path: str, blk: int, inside: int, depth: int):
        self.path, self.blk, self.inside, self.depth, self.k = path, blk, inside, depth, 0
        self.rest: list[pa.Array] = []
        self.low, self.two = 0, False

    def _rows(self, texts: pa.Array, two: np.ndarray, low: np.ndarray, ended: bool) -> pa.RecordBatch:
        n = len(texts)
        out = [pa.repeat(pa.scalar(self.path, pa.string()), n), pa.repeat(pa.scalar(self.blk, pa.int64()), n), pa.array(np.arange(self.k, self.k + n)),
               texts.cast(pa.string()), pa.array(two, pa.bool_()), pa.array([ended] * n, pa.bool_()), pa.array(low, pa.int64()),
               pa.array([self.depth if not ended else 1] * n, pa.int64()), pa.array([self.inside if not ended else 0] * n, pa.int32())]
        self.k += n
        return pa.RecordBatch.from_arrays(out, schema=_SEGMENTS)

    def add(self, value: pa.Array) -> Iterator[pa.RecordBatch]:
        """The elements that end in these pieces."""
        ends, at, kind = _marks(value)
        inside = (self.inside + np.concatenate([[0], np.cumsum(kind == _QUOTE)])) & 1
        step = np.where(inside[1:] == 0, (kind == _OPEN).astype(np.int64) - (kind == _CLOSE), 0)
        depth = self.depth + np.concatenate([[0], np.cumsum(step)])
        upto = np.searchsorted(at, ends)
        inside, depth = inside[upto], depth[upto]           # after each piece
        low = (depth < 1).astype(np.int64)
        brackets = np.flatnonzero(step)
        piece = np.searchsorted(ends, at[brackets], "right")
        two = np.zeros(len(value), bool)        # a closing bracket is never followed by an opening one
        two[piece[1:][(step[brackets[:-1]] < 0) & (step[brackets[1:]] > 0) & (piece[1:] == piece[:-1])]] = True
        stops = np.flatnonzero((inside == 0) & (depth == 1)) + 1
        self.inside, self.depth = int(inside[-1]), int(depth[-1])
        done = int(stops[-1]) if len(stops) else 0
        if done:
            starts = np.concatenate([[0], stops[:-1]])
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(starts, done)), value.slice(0, done)), _COMMA)
            two_s, low_s = np.logical_or.reduceat(two[:done], starts), np.add.reduceat(low[:done], starts)
            if self.rest:
                pieces = pa.concat_arrays([*self.rest, value.slice(0, int(stops[0]))])
                texts = pa.concat_arrays([_joined(pieces), texts.slice(1)])
                two_s[0] |= self.two
                low_s[0] += self.low
            yield self._rows(texts, two_s, low_s, True)
            self.rest, self.low, self.two = [], 0, False
        if done < len(value):
            self.rest.append(pa.concat_arrays([value.slice(done)]))
            self.low += int(low[done:].sum())
            self.two |= bool(two[done:].any())

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rest:
            yield self._rows(_joined(pa.concat_arrays(self.rest)), np.array([self.two]), np.array([self.low]), False)


def _joined(pieces: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(pieces)], pa.int64()), pieces), _COMMA)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of elements in each byte range, from rows (path, blk, value, s, depth0) in file order."""
    now = None
    for batch in batches:
        value = batch.column(2).cast(pa.large_string())
        for a, b in _runs(batch):
            path, blk, s, depth = (batch.column(i)[a].as_py() for i in (0, 1, 3, 4))
            if now is None or (now.path, now.blk) != (path, blk):
                if now is not None:
                    yield from now.close()
                now = _Range(path, blk, s, depth)
            yield from now.add(value.slice(a, b - a))
    if now is not None:
        yield from now.close()


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of whole files, from rows (path, value); pieces are cut as the text source cuts them."""
    for batch in batches:
        for i in range(batch.num_rows):
            value = batch.column(1).slice(i, 1).cast(pa.large_string())
            if pc.starts_with(value, "\ufeff")[0].as_py():
                value = pc.binary_slice(value.cast(pa.large_binary()), 3).cast(pa.large_string())
            pieces = pc.split_pattern(value, ",").flatten()
            if pc.binary_length(pieces[len(pieces) - 1]).as_py() == 0:
                pieces = pieces.slice(0, len(pieces) - 1)
            if len(pieces):
                now = _Range(batch.column(0)[i].as_py(), 0, 0, 0)
                yield from now.add(pa.concat_arrays([pieces]))
                yield from now.close()


_COMMA = pa.scalar(",", pa.large_string())
_EFFECTS = pa.schema([("path", pa.string()), ("blk", pa.int64()), ("odd", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64())])
_SEGMENTS = pa.schema([("path", pa.string()), ("blk", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("two", pa.bool_()), ("ended", pa.bool_()),
                       ("low", pa.int64()), ("depth", pa.int64()), ("inside", pa.int32())])
_SEGMENTS_DDL = "path string, blk long, k long, text string, two boolean, ended boolean, low long, depth long, inside int"


def _element_parts(spark: SparkSession, raw: DataFrame, per_file: Window, whole: DataFrame | None = None) -> DataFrame:
    """(path, blk, k, text, two, ended, low, depth, inside): the k-th part of an element in a byte range; stored.

    A file no larger than the least range is read once, as one row if ``whole`` (the same files, a row each)
    is given.  Of larger ones, a first pass finds the state at the start of each range.
    """
    least = min(_bytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes"))
    size = F.col("_metadata.file_size")
    pieces = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("blk"), "value"]
    small, large = raw.where(size <= least).select(*pieces), raw.where(size > least).select(*pieces)
    with _same_ranges(spark):
        effects = materialize(large.mapInArrow(_effects, "path string, blk long, odd int, d0 long, d1 long"), "effects")
        ranges = (effects.withColumn("s", (F.coalesce(F.sum("odd").over(per_file), F.lit(0)) % 2).cast("int"))
                  .withColumn("_d", F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1")))
                  .select("path", "blk", "s", F.coalesce(F.sum("_d").over(per_file), F.lit(0)).alias("depth0")))
        # one row for each range that isn't a file's first: a thousandth of a thousandth of the input, or less
        known = large.join(F.broadcast(ranges.where("blk > 0")), ["path", "blk"], "left")
        moved = F.raise_error(F.lit("a byte range was cut differently the second time")).cast("int")
        known = known.select("path", "blk", "value", F.coalesce("s", F.when(F.col("blk") > 0, moved).otherwise(F.lit(0))).alias("s"),
                             F.coalesce("depth0", F.lit(0)).cast("bigint").alias("depth0"))
        if whole is None:
            first = small.select("path", "blk", "value", F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("depth0")).mapInArrow(_segments, _SEGMENTS_DDL)
        else:
            first = whole.where(size <= least).select(pieces[0], "value").mapInArrow(_whole_files, _SEGMENTS_DDL)
        return _written(first.unionByName(known.mapInArrow(_segments, _SEGMENTS_DDL)), "element-parts")


def _empty_files(spark: SparkSession, raw: DataFrame, read: DataFrame) -> DataFrame:
    """Files of length 0 as rows like those of ``read``; file scans leave them out, the listing has them."""
    names = [re.sub("^file:/+", "file:/", p) for p in raw.inputFiles()]
    if len(names) == read.count():
        names = []
    listed = spark.createDataFrame([(p,) for p in names], "path string")
    return listed.join(read, "path", "left_anti").select("path", F.lit(None).cast("bigint").alias("last"), F.lit("empty file").alias("reason"))


def scan_arrays(spark: SparkSession, paths: str | Sequence[str]) -> ArrayFiles:
    """The elements of every array file, in file and array order, and what can't be read."""
    raw = spark.read.option("lineSep", ",").text(paths)
    per_file = Window.partitionBy("path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    parts = _element_parts(spark, raw, per_file, spark.read.text(paths, wholetext=True))
    sums = parts.groupBy("path", "blk").agg(
        F.sum(F.col("ended").cast("bigint")).alias("ends"), F.sum("low").alias("low"), F.max_by("depth", "k").alias("depth"),
        F.max_by("inside", "k").alias("inside"), F.max((F.col("k") == 0) & F.col("text").rlike(r"\A\s*\[")).alias("opens"),
        F.max(~F.col("ended") & F.col("text").rlike(r"\]\s*\z")).alias("closes"))
    sums = materialize(sums.withColumn("before", F.coalesce(F.sum("ends").over(per_file), F.lit(0))), "range-sums")
    files = sums.groupBy("path").agg(
        F.sum("ends").alias("last"), F.sum("low").alias("low"), F.max_by("depth", "blk").alias("depth"), F.max_by("inside", "blk").alias("inside"),
        F.min_by("opens", "blk").alias("opens"), F.max_by("closes", "blk").alias("closes"))
    verdict = files.select("path", "last", F.when(~F.col("opens"), F.lit("does not start with a JSON array")).when(
        (F.col("inside") != 0) | (F.col("depth") > 0), F.lit("cut off: the array does not end")).when(
        (F.col("low") != 1) | (F.col("depth") != 0) | ~F.col("closes"), F.lit("text after the end of the array")).alias("reason"))
    verdict = materialize(verdict.unionByName(_empty_files(spark, raw, verdict)), "files")

    good = sums.select("path", "blk", "before").join(verdict.where("reason IS NULL").select("path", "last"), "path")
    if sums.count() <= _MAX_BROADCAST_RANGES:
        good = F.broadcast(good)
    at = parts.join(good, ["path", "blk"]).withColumn("idx", (F.col("before") + F.col("k")).cast("bigint"))
    alone = F.col("ended") & (F.col("k") > 0)       # begins and ends in its range; at most two others a range
    joined = (at.where(~alone).groupBy("path", "idx", "last").agg(F.sort_array(F.collect_list(F.struct("blk", "text"))).alias("_p"), F.max("two").alias("two"))
              .withColumn("text", F.array_join(F.transform("_p", lambda x: x["text"]), ",")))
    text = F.when(F.col("idx") == 0, F.regexp_replace("text", r"\A\s*\[", "")).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    joined = joined.withColumn("text", F.when(F.col("idx") == F.col("last"), F.regexp_replace("text", r"\]\s*\z", "")).otherwise(F.col("text")))
    joined = joined.where(~((F.col("last") == 0) & F.col("text").rlike(r"\A\s*\z")))   # an empty array
    joined = at.where(alone).select("path", "idx", "text", "two").unionByName(joined.select("path", "idx", "text", "two"))
    elements = joined.select("path", "idx", "text", _one_value().alias("ok"), "two")
    damaged = verdict.where("reason IS NOT NULL").select("path", F.lit(None).cast("bigint").alias("place"), "reason")
    return ArrayFiles(elements, damaged, damaged.unionByName(elements.where("NOT ok").select("path", F.col("idx").alias("place"), F.lit(_NO_VALUE).alias("reason"))))


_NO_VALUE = "not a JSON value"


def _one_value():
    return F.coalesce(F.expr("json_array_length(concat('[', text, ']')) = 1"), F.lit(False)) & ~F.col("two")


def _looked_at(files: ArrayFiles, rows: DataFrame, cols: Sequence[str]) -> ArrayFiles:
    """``rows`` with a reason ``_why`` (NULL: none), stored, so that every element is parsed once."""
    rows = _written(rows, "elements")
    wrong = rows.where("_why IS NOT NULL").select("path", F.col("idx").alias("place"), F.col("_why").alias("reason"))
    return ArrayFiles(rows.select("path", "idx", *cols), files.damaged, files.damaged.unionByName(wrong))


def as_strings(files: ArrayFiles, out_col: str = "output") -> ArrayFiles:
    """Elements as strings (``out_col``); any other value is a problem, and NULL."""
    bare = F.regexp_replace(F.trim(F.regexp_replace("text", r"[\t\r\n]", " ")), _ESCAPE, "")
    rows = files.elements.withColumn("_bare", bare)
    is_string = F.col("ok") & F.col("_bare").startswith('"') & F.col("_bare").endswith('"') & (
        F.length("_bare") - F.length(F.translate("_bare", '"', "")) == 2)
    value = F.get(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>"), 0)
    rows = rows.select("path", "idx", "ok", F.when(is_string, value).alias(out_col))
    why = F.when(~F.col("ok"), F.lit(_NO_VALUE)).when(F.col(out_col).isNull(), F.lit("not a string"))
    return _looked_at(files, rows.select("path", "idx", out_col, why.alias("_why")), [out_col])


def as_rows(files: ArrayFiles, schema: str, required: Sequence[str]) -> ArrayFiles:
    """Elements as columns of ``schema`` (DDL); what isn't such an object is a problem, and NULL."""
    rows = with_object(files.elements.drop("ok"), "text", schema, required, _one_value(), F.lit(_NO_VALUE)).select("path", "idx", "_r", "_why")
    return _looked_at(files, rows, [F.col("_r")[c].alias(c) for c in rows.schema["_r"].dataType.names if c != "_corrupt"])


def with_object(df: DataFrame, text: str, schema: str, required: Sequence[str], ok=None, not_ok=None) -> DataFrame:
    """``df`` with ``_r`` (struct of ``schema``) of column ``text`` and ``_why`` it isn't such an object (NULL: it is).

    The text is parsed in a step of its own, as several columns are derived from it.  Rows for which ``ok``
    doesn't hold get the reason ``not_ok``.
    """
    # from a generator: a filter on columns derived from it would otherwise repeat the parsing
    df = df.select("*", F.explode(F.array(F.from_json(text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))).alias("_r"))
    keys = F.json_object_keys(text)
    missing = F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), keys)
    reason = (F.when(keys.isNull(), F.lit("not a JSON object"))
              .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
              .when(F.col("_r")["_corrupt"].isNotNull(), F.lit("does not fit the schema")))
    why = reason if ok is None else F.when(~ok, not_ok).otherwise(reason)
    if required:
        df = df.withColumn("_why", F.when(_plain_object(text, required, ends=ok is not None), F.lit(None).cast("string")).otherwise(why))
    else:
        df = df.withColumn("_why", why)
    return df.withColumn("_r", F.when(F.col("_why").isNull(), F.col("_r")))


def _plain_object(text: str, required: Sequence[str], ends: bool):
    """True if the parsed ``_r`` alone shows that the text is such an object, which needs no second parsing.

    A required value that isn't NULL had its key.  NaN and the infinities are values to ``from_json`` only, so
    a text that may hold them is left to the other checks.  With ``ends`` nothing may follow the object:
    brackets balance in an element, so one that opens first, closes last and has no ``two`` is one value.
    """
    fits = F.col(text).startswith("{") & F.col("_r")["_corrupt"].isNull()
    for c in required:
        fits = fits & F.col("_r")[c].isNotNull()
    for word in ("NaN", "Inf", "INF"):
        fits = fits & ~F.col(text).contains(word)
    if ends:
        fits = fits & F.col(text).endswith("}") & ~F.col("two")
    return F.coalesce(fits, F.lit(False))


def whole_strings(text: str):
    """(array of strings, why the text of column ``text`` isn't one or NULL), for small files read whole."""
    outside = F.regexp_replace(F.regexp_replace(text, _ESCAPE, ""), _STRING, "")
    array = F.from_json(text, "array<string>")
    commas = F.length(outside) - F.length(F.translate(outside, ",", ""))
    fits = outside.rlike(r"\A\s*\[[\s,]*\]\s*\z") & (commas == F.greatest(F.size(array) - 1, F.lit(0)))
    reason = (F.when(F.col(text).rlike(r"\A\s*\z"), F.lit("empty file")).when(array.isNull(), F.lit("not a JSON array"))
              .when(~fits, F.lit("not an array of strings")))
    return F.when(reason.isNull(), array), reason
