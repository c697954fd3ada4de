"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every letter gives three features: the letter, the letter with its
right neighbour, the letter with both neighbours (a non-letter counts as a blank).  Each is
hashed to one of ``2**bits`` buckets.  Training counts the buckets per language in Spark;
the log-probability matrix (buckets x languages, a fixed number of numbers per language) is
broadcast, and a batch of texts is scored as a sparse product in numpy: the rows of the
features at hand are gathered and summed per text.

The score is the probability of the predicted language with the log-likelihood divided by
the root of the number of letters: naive Bayes takes neighbouring n-grams as independent,
and without this every text of a few lines would score exactly 1.

Edge cases: NULL text or a text without letters gives ``und`` and score 0; ties go to the
alphabetically first language; without any labelled row every text is ``und``; repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatio.llm.chunks import shared_table
from curatio.llm.common import text_slices

BITS = 15
TRAIN_PER_LANG = 4000
UND = "und"
_STEP = 1 << 18


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prob: np.ndarray    # buckets x languages, float32
    log_prior: np.ndarray


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a blank."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts with blanks around each, end of each text)."""
    low = [(t or "").lower() + " " for t in texts]
    joined = (" " + "".join(low)).encode("utf-32-le", "surrogatepass")
    ends = 1 + np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    return shared_table("letters", _letters)[np.frombuffer(joined, "<u4")], ends


def _buckets(c: np.ndarray, at: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bucket of the one-, two- and three-letter feature at each letter position."""
    mid = c[at].astype(np.uint64)
    right = mid * np.uint64(0x1F123BB5) + c[at + 1]
    wide = right * np.uint64(0x9E3779B1) + c[at - 1]
    for salt, x in enumerate((mid, right, wide), 1):
        h = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """In bounded steps: (text number of each letter, its three buckets)."""
    c, ends = _code_points(texts)
    for lo in range(0, len(c), _STEP):
        at = lo + np.flatnonzero(c[lo:lo + _STEP] != 32)
        if len(at):
            yield np.searchsorted(ends, at, side="right"), list(_buckets(c, at, bits))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          per_lang: int = TRAIN_PER_LANG, bits: int = BITS) -> Model:
    """Fit on about ``per_lang`` labelled rows of each language (all, if there are fewer).

    The rows are chosen by a hash of the id; ``per_lang`` bounds the fit's cost only, every
    row given is scored by ``predict``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())   # one row per language
    langs = [x for x, _ in counts]
    if not langs:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << bits), np.int64)
        for batch, texts in text_slices(batches, limit=400_000):
            of = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for doc, found in features(texts, bits):
                for b in found:
                    total += np.bincount(of[doc] << bits | b, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["l", "b", "n"])
    got = (rows.where(part).select("lang", "text").mapInArrow(run, "l long, b long, n long")
           .groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas())     # at most languages x buckets rows
    table = np.ones((1 << bits, len(langs)))
    table[got["b"].to_numpy(np.int64), got["l"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    prior = np.array([n for _, n in counts], float)
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(predicted language, score) of each text."""
    k, bits = len(model.langs), int(np.log2(len(model.log_prob)))
    sums, letters = np.zeros((len(texts), k)), np.zeros(len(texts))
    for doc, found in features(texts, bits):
        first, n = doc[0], doc[-1] - doc[0] + 1
        cuts = np.flatnonzero(np.diff(doc, prepend=first - 1))
        rows = model.log_prob[found[0]] + model.log_prob[found[1]] + model.log_prob[found[2]]
        sums[doc[cuts]] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
        letters[first:first + n] += np.bincount(doc - first, minlength=n)
    if not k:
        return [UND] * len(texts), np.zeros(len(texts))
    z = (sums + model.log_prior) / np.sqrt(np.maximum(letters, 1.0))[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    some = letters > 0
    return ([model.langs[b] if s else UND for b, s in zip(best, some, strict=True)],
            np.where(some, p[np.arange(len(p)), best], 0.0))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The ``keep`` columns (default: all) of every row with its language and score.

    Only the text decides; a kept column that has an output's name is replaced.  A text that
    is kept travels to the tasks once.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (lang_out, score_out)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType(list(rows.schema.fields)).add(lang_out, "string").add(score_out, "double")
    if text_col in keep and rows.schema[text_col].dataType.typeName() == "string":
        source = text_col
    else:
        source = "_text"
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias(source))
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, source, limit=500_000):
            langs, scores = score_texts(shared.value, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(langs, pa.string()), pa.array(scores)],
                                             [*keep, lang_out, score_out])
    return rows.mapInArrow(run, schema)
