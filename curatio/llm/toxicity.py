"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (plain, weighted, obfuscated, and
how many different entries occur), second-person words and how near they stand to lexicon
words, capitals, punctuation, digits, obfuscation (letters mixed with digits or symbols,
drawn-out letters), repeated words and length.

Training uses labelled rows in three parts by a hash of the id: one for the lexicon (words
whose document frequency is much higher among toxic rows), one for the trees, one for the
calibration; ``max_rows`` bounds each part's rows per class.  Every given row is scored.

Edge cases: NULL or empty text is scored with all features zero; without labelled rows of
both classes the score is the constant prior; repeated rows score alike; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm import boosting
from curatio.llm.chunks import ChunkTable, ragged, shared_table
from curatio.llm.common import text_slices

MAX_ROWS = 12_000       # labelled rows per class and part
LEXICON = 300
WINDOW = 6              # words between a second-person word and a lexicon word that count as near

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti tus tuyo usted ustedes vos vous votre vos toi ton ta tes "
                          "du dich dir dein deine deinen sie ihr euch euer".split())
_LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!*#._-]+[^\W\d_]")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_WIDTH = 13


def plain(chunk: str) -> str:
    """A chunk's word: lower case, without symbols at its ends."""
    return _EDGE.sub("", chunk.lower())


def revealed(chunk: str) -> str:
    """The word behind look-alike characters, dots between letters and drawn-out letters."""
    return _DRAWN.sub(r"\1", re.sub(r"[\W_]+", "", chunk.lower().translate(_LOOKS_LIKE)))


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: boosting.Boosted
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))


def _chunk_values(lexicon: dict[str, float]):
    place = {w: i + 1 for i, w in enumerate(lexicon)}

    def values(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for c in chunks:
            word = plain(c)
            mixed = bool(_MIXED.search(c)) or bool(_DRAWN.search(c))
            hidden = revealed(c) if mixed and word not in place else ""
            hit = word if word in place else hidden if hidden in place else ""
            letters = sum(map(str.isalpha, c))
            caps = sum(map(str.isupper, c))
            out.append([1.0, len(c), letters, caps, float(caps == letters and letters > 2), sum(map(str.isdigit, c)),
                        float(len(c) - sum(map(str.isalnum, c))), c.count("!") + c.count("?"), float(mixed),
                        float(word in SECOND_PERSON), place.get(hit, 0), lexicon.get(hit, 0.0), float(bool(hit) and hit != word)])
        return ragged(out, np.float32)
    return values


def features(texts: list[str | None], lexicon: dict[str, float], key) -> np.ndarray:
    """One row of dense features per text."""
    table = shared_table(("toxicity", key), lambda: ChunkTable(_chunk_values(lexicon), np.float32, limit=120_000))
    flat, counts = table.rows(texts)
    flat, n = flat.reshape(-1, _WIDTH), counts // _WIDTH
    out = np.zeros((len(texts), 15))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts = (np.cumsum(n) - n)[some]
    sums = np.add.reduceat(flat, starts, axis=0, dtype=np.float64)
    doc = np.repeat(np.arange(len(some)), n[some])
    entry = flat[:, 10].astype(np.int64)
    at = np.flatnonzero(entry)
    kinds = np.bincount(np.unique(doc[at] * (len(lexicon) + 1) + entry[at]) // (len(lexicon) + 1), minlength=len(some))
    you = np.flatnonzero(flat[:, 9])
    near = np.zeros(len(some))
    if len(you) and len(at):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
        near = np.bincount(doc[at], gap <= WINDOW, minlength=len(some))
    hits = np.bincount(doc[at], minlength=len(some))
    top = np.zeros(len(some))
    np.maximum.at(top, doc[at], flat[at, 11])
    words, letters = sums[:, 0], np.maximum(sums[:, 2], 1)
    out[some] = np.stack([
        np.log1p(words), hits, hits / words, sums[:, 11], sums[:, 11] / words, top, kinds, sums[:, 12], near,
        sums[:, 9] / words, sums[:, 3] / letters, sums[:, 4] / words, sums[:, 6] / sums[:, 1], sums[:, 7] / words,
        sums[:, 8] / words], axis=1)
    return out


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    y = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
         .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(y), "_id")     # about 6 * max_rows rows at most, so the texts stay where they are


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS, lexicon_size: int = LEXICON) -> Model:
    """Fit on ``labels`` rows (ids not to be learned from must already be left out).

    Only labelled texts are read, at most about ``max_rows`` of each class in each of the
    three parts (chosen by a hash of the id): a documented bound on the fit alone.
    """
    y = labels.where(F.col(label_col).isin(0, 1))
    n = {r[0]: r[1] for r in y.groupBy(label_col).count().collect()}
    if len(n) < 2:
        prior = float(next(iter(n), 0))
        return Model({}, boosting.Boosted(0.0, [], 1), np.zeros(1), np.full(1, prior))
    share = F.when(F.col(label_col) == 1, min(1.0, 3 * max_rows / n[1])).otherwise(min(1.0, 3 * max_rows / n[0]))
    y = y.where(F.pmod(F.xxhash64(F.lit("row"), F.col(id_col)), F.lit(1 << 20)) < share * (1 << 20))
    rows = _labelled(docs, y, id_col, text_col, label_col).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(3))).select("y", "part", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], int] = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()),
                                               pa.array(list(seen.values()), pa.int64())], ["y", "word", "n"])
        for batch, texts in text_slices(batches):
            for label, t in zip(batch.column("y").to_pylist(), texts, strict=True):
                for w in {plain(c) for c in set((t or "").split())}:
                    seen[label, w] = seen.get((label, w), 0) + 1
            if len(seen) > 200_000:
                yield sent()
                seen.clear()
        yield sent()
    df = (rows.where("part = 0").mapInArrow(words, "y int, word string, n long").where("word <> ''").groupBy("word")
          .agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(y = 0, n, 0)")).alias("neg")))
    sizes = {r[0]: r[1] for r in rows.where("part = 0").groupBy("y").count().collect()}
    p, q = F.col("pos") / max(1, sizes.get(1, 0)), F.col("neg") / max(1, sizes.get(0, 0))
    pooled = (F.col("pos") + F.col("neg")) / max(1, sum(sizes.values()))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / max(1, sizes.get(1, 0)) + 1 / max(1, sizes.get(0, 0))) + F.lit(1e-12))
    odds = F.log((p + 1e-4) / (q + 1e-4))
    top = (df.where("pos >= 4").select("word", odds.alias("w"), ((p - q) / spread).alias("z")).where("z > 4 and w > 0.7")
           .orderBy(F.desc("z"), "word").limit(lexicon_size).collect())
    lexicon = {r.word: float(r.w) for r in top}
    key = hash(tuple(sorted(lexicon.items())))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            x = features(texts, lexicon, key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("part"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                ["y", "part", "x"])
    got = (rows.where("part > 0").mapInArrow(dense, "y int, part long, x array<double>")
           .orderBy("part", "y", "x").toPandas())     # at most 4 * max_rows rows of 15 numbers
    x, yy, part = (np.array(got["x"].tolist()).reshape(len(got), -1), got["y"].to_numpy(float), got["part"].to_numpy())
    fit, cal = part == 1, part == 2
    trees = boosting.fit(x[fit], yy[fit])
    # the sample may hold the classes in other shares than the table: weigh the calibration back
    weight = np.where(yy == 1, n[1] / max(1, (yy == 1).sum()), n[0] / max(1, (yy == 0).sum()))
    knots, values = boosting.isotonic(trees.margin(x[cal]), yy[cal])
    if len(set(yy[cal])) == 2 and abs(weight.max() / weight.min() - 1) > 0.2:
        odds1 = values / np.maximum(1 - values, 1e-9) * (weight[yy == 1][0] / weight[yy == 0][0])
        values = odds1 / (1 + odds1)
    return Model(lexicon, trees, knots, np.clip(values, 0.0, 1.0))


def score_texts(model: Model, texts: list[str | None], key) -> np.ndarray:
    margin = model.trees.margin(features(texts, model.lexicon, key))
    return np.interp(margin, model.knots, model.values)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
          score_out: str = "score") -> DataFrame:
    """The ``keep`` columns (default: all) of every row with its toxicity score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_out]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(tuple(sorted(model.lexicon.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score_texts(shared.value, texts, key))],
                                             [*keep, score_out])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, rows.drop("_text").schema.add(score_out, "double"))
