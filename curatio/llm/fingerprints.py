"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is divided into paragraphs (lines; long ones at sentence ends, long sentences at
commas and then after words chosen by their hash, or after twelve words without one, so that
an edit moves few borders).
Each paragraph's digest, labelled with its occurrence number, goes into three cells of a
sketch; a cell keeps a count, the sum of its digests and the sum of their checks.  Cells of
two versions are subtracted; what both hold cancels out, and peeling cells that hold one
digest recovers the digests in which the versions differ.  When peeling stalls, both
sketches are made again twice as large (with other cell choices), until it succeeds.

The likeness of two fingerprints is 2 * shared / (paragraphs of both).

Edge cases: NULL text is empty; an empty text has no paragraph, and two empty texts have
likeness 1; equal texts have equal fingerprints; repeated paragraphs count by occurrence; rows of
equal id are ordered by their text; a NULL id comes after every other; a table of one
document has that document as its next one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import text_slices

CELLS = 24              # of the fingerprint itself; a multiple of 3
_LOWEST = -(1 << 63)
_CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("keys", "<u8")])


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        for sentence in line.split(". "):
            if len(sentence) <= 60:
                out.append(sentence)
                continue
            for clause in sentence.split(", "):
                if len(clause) <= 100:
                    out.append(clause)
                    continue
                first, words = 0, clause.split(" ")
                for i, w in enumerate(words):
                    if zlib.crc32(w.encode("utf-8", "surrogatepass")) & 3 == 0 or i - first >= 11:
                        out.append(" ".join(words[first:i + 1]))
                        first = i + 1
                out.append(" ".join(words[first:]))
    return [x for x in out if x]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def digests(text: str) -> np.ndarray:
    """The text's paragraph digests, each labelled with its occurrence number; all differ."""
    d = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in paragraphs(text)], np.uint64)
    order = np.argsort(d, kind="stable")
    s = d[order]
    if len(s) > 1 and (s[1:] == s[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        s = np.where(nth > 0, _mix(s + nth.astype(np.uint64), 77), s)
    return s


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [(_mix(keys, cells + k) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)]


class Sketches:
    """``n`` sketches of the same number of cells, as arrays."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.keys = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def add(self, of: np.ndarray, keys: np.ndarray, sign: int | np.ndarray = 1) -> np.ndarray:
        """Puts each key into sketch ``of``; sign -1 subtracts.  Returns the cells touched."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        us, check = sign.astype(np.uint64), _mix(keys, 5)
        touched = []
        for place in _places(keys, self.cells):
            at = of * self.cells + place
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, us * keys)
            np.add.at(self.check, at, us * check)
            touched.append(at)
        return np.concatenate(touched)

    def text(self, i: int) -> str:
        """The cells of sketch ``i``, as a string."""
        part = slice(i * self.cells, (i + 1) * self.cells)
        cell = np.empty(self.cells, _CELL)
        cell["count"], cell["keys"], cell["check"] = self.count[part], self.keys[part], self.check[part] >> np.uint64(32)
        return base64.b64encode(cell.tobytes()).decode()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, key, sign) of every recovered digest, emptying the cells they lay in."""
        found: list = []
        look = np.flatnonzero(self.count)
        while len(look):
            c = self.count[look]
            one = look[(c == 1) | (c == -1)]
            sign = self.count[one]
            keys = self.keys[one] * sign.astype(np.uint64)
            good = _mix(keys, 5) * sign.astype(np.uint64) == self.check[one]
            of, keys, sign = one[good] // self.cells, keys[good], sign[good]
            if not len(of):
                break
            order = np.lexsort((keys, of))
            of, keys, sign = of[order], keys[order], sign[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])])
            of, keys, sign = of[new], keys[new], sign[new]
            found.append((of, keys, sign))
            look = np.unique(self.add(of, keys, -sign))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def stalled(self) -> np.ndarray:
        """Which sketches still hold something after ``peel``."""
        return ((self.count != 0) | (self.keys != 0)).reshape(self.n, self.cells).any(axis=1)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    return np.repeat(np.arange(len(sets)), n), np.concatenate([*sets, np.zeros(0, np.uint64)])


def sketch(sets: list[np.ndarray], cells: int = CELLS) -> Sketches:
    out = Sketches(len(sets), cells)
    out.add(*_flat(sets))
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS
                ) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pair: the digests only ``a`` has, and those only ``b`` has, by peeling."""
    only_a: list = [np.zeros(0, np.uint64)] * len(a)
    only_b = list(only_a)
    todo = np.arange(len(a))
    least = np.array([abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)])
    while len(todo):
        now = todo[least[todo] <= cells]        # fewer cells than differences can't be peeled
        diff = sketch([a[i] for i in now], cells)
        of, keys = _flat([b[i] for i in now])
        diff.add(of, keys, -1)
        of, keys, sign = diff.peel()
        order = np.argsort(of, kind="stable")
        of, keys, sign = of[order], keys[order], sign[order]
        cuts = np.searchsorted(of, np.arange(len(now) + 1))
        for k in np.flatnonzero(~diff.stalled()):
            part = slice(cuts[k], cuts[k + 1])
            only_a[now[k]], only_b[now[k]] = keys[part][sign[part] > 0], keys[part][sign[part] < 0]
        done = now[~diff.stalled()]
        todo = np.setdiff1d(todo, done)
        cells *= 2
    return only_a, only_b


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    only_a, only_b = differences(a, b)
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    apart = np.array([len(x) + len(y) for x, y in zip(only_a, only_b, strict=True)], float)
    return np.where(total > 0, (total - apart) / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(docs: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(t, x) for t, x in zip(texts, following, strict=True)]
    sets = [digests(t) for t in texts]
    after = [*sets[1:], digests(following[-1])] if following[:-1] == texts[1:] else [digests(x) for x in following]
    other = [digests(t) for t in changed]
    own, its = sketch(sets), sketch(other)
    near = likeness(sets + sets, other + after)
    n = len(texts)
    return pa.RecordBatch.from_arrays([
        pa.array(docs, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array([f"{len(s)}:{own.text(i)}" for i, s in enumerate(sets)]),
        pa.array([f"{len(s)}:{its.text(i)}" for i, s in enumerate(other)]),
        pa.array(near[:n]), pa.array(near[n:]), pa.array([len(s) for s in sets], pa.int64())], _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs"]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, n_paragraphs long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, copy, key, doc_id, text): rows dealt into runs of descending id, one shuffle of the texts.

    A run is a range of ids (borders from a shuffle of the ids alone).  The row with the
    largest id of each run also goes, marked ``copy``, to the run above, whose last document
    it follows; the largest of all goes to the lowest run.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST)).alias("key"))
    spark = docs.sparkSession
    runs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = (rows.select("key").repartitionByRange(runs, "key").groupBy(F.spark_partition_id().alias("p"))
            .agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect())    # one row per run
    low, high = np.array([r.lo for r in ends], np.int64), np.array([r.hi for r in ends], np.int64)

    @F.pandas_udf("array<int>")
    def targets(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        run = np.searchsorted(low, k, side="right") - 1
        up = np.where(run + 1 < len(low), run + 1, 0)
        return pd.Series([[r, u] if last else [r] for r, u, last in zip(run.tolist(), up.tolist(), (k == high[run]).tolist(), strict=True)])
    dealt = rows.select("*", F.posexplode(targets("key")).alias("copy", "bucket"))
    return (dealt.repartition("bucket")
            .sortWithinPartitions("bucket", "copy", F.desc("key"), "text").select("bucket", "copy", "key", "doc_id", "text"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likenesses; columns of ``_SCHEMA``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []          # rows of one bucket whose following text isn't known yet
        bucket, closed = None, False

        def pairs(ready: list[tuple], last: str) -> pa.RecordBatch:
            texts = [t for _, t in ready]
            return _rows([d for d, _ in ready], texts, [*texts[1:], last])
        for part, texts in text_slices(batches, limit=1_000_000):
            for b, copy, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                          part.column(3).to_pylist(), texts, strict=True):
                if b != bucket:
                    bucket, closed = b, False
                if not copy:
                    held.append((doc, text))
                elif not closed and held:
                    yield pairs(held, text)
                    held, closed = [], True
            if len(held) > 1:
                yield pairs(held[:-1], held[-1][1])
                held = held[-1:]
    return with_next(docs, id_col, text_col).mapInArrow(run, _SCHEMA)
