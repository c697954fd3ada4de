"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's words (lower case, letters and digits) give shingles of ``K`` = 5 words, each labelled with its
occurrence number, so all labelled shingles of a text differ.  An entry of the sketch takes
the ``L`` labelled shingles that are smallest under the entry's hash and keeps them in text
order; two texts agree in an entry if these tuples are equal, which needs the same shingles
in the same order.  At similarity 0.8 an entry agrees with probability of about 0.8**5, so
32 entries miss a pair with about 3 in a million; texts of at most ``SHORT`` shingles get 16
entries of one shingle besides.

Similarity of two texts is ``m / (a + b - m)`` with ``m`` the longest common subsequence of
their labelled shingles, found within the band that similarity ``threshold`` allows; as
labelled shingles are unique, it is the longest increasing run of matching positions.  It is
at most the shingles' Jaccard similarity and equals it where the order is the same.

Jobs:
1. One pass over the texts writes sketches and word hashes to a scratch table.
2. Texts of equal word sequence form one class with its smallest id as representative; only
   representatives go on.
3. A bucket (entry, tuple) of two or more representatives compares each of them with the
   bucket's smallest; buckets of equal members count once.  The pairs of one smallest id are cut
   into groups of bounded size.
4. A bucket in which somebody was not similar to the smallest is examined in full, in bands of
   text length (a similar pair's lengths differ by a fifth at most): those that were not
   similar are compared with all others, until they are connected.  A large band is dealt
   into blocks, and each pair of blocks is a group of bounded size of its own.
5. Connected components of the links, with the copies, are the classes.

Edge cases: texts without words (NULL, empty, only symbols) are classes of their own; texts of
1 to 4 words have one shingle, all their words; a NULL id takes no part and has a NULL
class; repeated rows share a class; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.chunks import ChunkTable, ragged, shared_table
from curatio.llm.common import components, id_and_text, join_hot_safe, text_slices, written

K, L, ENTRIES, SHORT, SHORT_ENTRIES, THRESHOLD = 5, 5, 32, 16, 16, 0.8
GROUP = 256             # pairs of one pivot that one group verifies
BLOCK, BLOCK_WORDS = 1024, 1 << 19      # texts and words of one block of a large open bucket
_WORD = re.compile(r"[^\W_]+")
_R = np.random.default_rng(20)
_MUL = (_R.integers(0, 1 << 32, ENTRIES + SHORT_ENTRIES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_STEP = _R.integers(0, 1 << 63, max(K, L), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_table() -> ChunkTable:
    def values(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return ragged([[xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(c.lower())] for c in chunks], np.uint32)
    return shared_table("words32", lambda: ChunkTable(values, np.uint32, limit=100_000))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles in text order, from the word hashes."""
    w = words.astype(np.uint64)
    if not len(w):
        return w
    k = min(K, len(w))
    n = len(w) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s += (w[i:i + n] + np.uint64(1)) * _STEP[i]
    s = _mix(s + np.uint64(k))
    order = np.argsort(s, kind="stable")
    same = s[order][1:] == s[order][:-1]
    if same.any():
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        nth = np.empty(n, np.uint64)
        nth[order] = (np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))).astype(np.uint64)
        s = np.where(nth > 0, _mix(s + nth), s)
    return s


def _smallest(h: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) columns of the ``count`` smallest values of each row, in column order.

    Ties go to the smaller column.  Few values lie below a bar where about four times as
    many as needed are expected; rows with too few there are done in full.
    """
    rows, n = h.shape
    if n <= 4 * count:
        order = np.argsort(h, axis=1, kind="stable")[:, :count]
        return np.sort(order, axis=1)
    bar = np.uint32(min(0xFFFFFFFF, int((1 << 32) * 4.0 * count / n)))
    row, col = np.nonzero(h < bar)
    got = np.bincount(row, minlength=rows)
    out = np.empty((rows, count), np.int64)
    order = np.lexsort((col, h[row, col], row))
    first = np.cumsum(got) - got
    fine = got >= count
    at = first[fine][:, None] + np.arange(count)
    out[fine] = np.sort(col[order][at], axis=1)
    for r in np.flatnonzero(~fine):
        out[r] = np.sort(np.argsort(h[r], kind="stable")[:count])
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bucket numbers (signed 64-bit) of one text: one per entry, and more for short texts."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    x = (shingles >> np.uint64(16)).astype(np.uint32) * _MUL
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    out = []
    if len(shingles) >= L:
        tuples = shingles[_smallest(x[:ENTRIES], L)]
        out.append(_mix((tuples * _STEP[:L]).sum(axis=1, dtype=np.uint64) + np.arange(ENTRIES, dtype=np.uint64)))
    if len(shingles) <= SHORT:
        one = shingles[x[ENTRIES:].argmin(axis=1)]
        out.append(_mix(one + np.arange(1000, 1000 + SHORT_ENTRIES, dtype=np.uint64)))
    return np.concatenate(out).view(np.int64)


def _longest_run(b: np.ndarray) -> int:
    if len(b) < 2 or (b[1:] > b[:-1]).all():
        return len(b)
    tails: list[int] = []
    for v in b.tolist():
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Banded alignment of two labelled shingle sequences; 0 where it is certain to be below."""
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < threshold * (len(a) + len(b) - len(ia)):
        return 0.0
    band = (1 / threshold - 1) * min(len(a), len(b))
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    m = _longest_run(ib[np.abs(ia - ib) <= band])
    return m / (len(a) + len(b) - m)


# --- jobs ---------------------------------------------------------------------------------

_SKETCH = "doc_id long, k1 long, k2 long, n long, buckets array<long>, words binary"


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table()
        for part, texts in text_slices(batches, limit=500_000):
            flat, counts = table.rows(texts)
            ends = np.cumsum(counts)
            k1, k2, n, buckets, words = [], [], [], [], []
            for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
                w = flat[e - c:e]
                raw = w.astype("<u4").tobytes()
                d = xxhash.xxh3_128_digest(raw)
                s = labelled_shingles(w)
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                n.append(len(s))
                buckets.append(sketch(s))
                words.append(raw)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(k1), pa.array(k2), pa.array(n, pa.int64()), pa.array(buckets, pa.list_(pa.int64())),
                 pa.array(words, pa.binary())], ["doc_id", "k1", "k2", "n", "buckets", "words"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, _SKETCH)


def _shingles_of(words: bytes) -> np.ndarray:
    return labelled_shingles(np.frombuffer(words, "<u4"))


def verify_pairs(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs (rep, pivot) whose alignment reaches the threshold."""
    sizes = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"))
    total = sizes.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    dealt = join_hot_safe(pairs, sizes, ["pivot"], "c", int(total)).select(
        "rep", "pivot", F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / GROUP)).cast("int").alias("part"))
    own = dealt.join(words, "rep")
    sizes = sizes.select(F.col("pivot").alias("of"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("c") / GROUP) - 1).cast("int"))).alias("nth"))
    theirs = sizes.join(words.select(F.col("rep").alias("of"), F.col("words").alias("text_words")), "of")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        p = _shingles_of(right["text_words"].iloc[0])
        keep = [similarity(_shingles_of(w), p, threshold) >= threshold for w in left["words"]]
        return pd.DataFrame({"a": left["rep"][keep], "b": left["pivot"][keep]})
    return own.groupBy("pivot", "part").cogroup(theirs.groupBy("of", "nth")).applyInPandas(run, "a long, b long")


def group_links(ids: list[int], shingles: list[np.ndarray], linked: list[bool], threshold: float,
                side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the members of a group of which the ``linked`` ones are connected already.

    Overlaps come from an index of the group's shingles; pairs that may reach the threshold
    are aligned, unless they are connected by then.  With ``side``, only members of
    different sides are compared.
    """
    sizes = np.array([len(s) for s in shingles])
    codes, inverse = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(inverse, kind="stable")
    start = np.searchsorted(inverse[order], np.arange(len(codes) + 1))
    owners = owner[order]
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    first = next((i for i, x in enumerate(linked) if x), None)
    for i, x in enumerate(linked):
        if x:
            root[i] = first
    ends = np.cumsum(sizes)
    out = []
    for i in range(len(ids)):
        if linked[i]:
            continue
        mine = inverse[ends[i] - sizes[i]:ends[i]]
        lengths = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        common = np.bincount(owners[at], minlength=len(ids))
        near = common >= threshold * (sizes + sizes[i] - common)
        if side is not None:
            near &= side != side[i]
        for j in np.flatnonzero(near).tolist():
            if (j > i or linked[j]) and find(i) != find(j) and similarity(shingles[i], shingles[j], threshold) >= threshold:
                root[find(i)] = find(j)
                out.append((ids[i], ids[j]))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copy_of, n_shingles) of every row: class_id is the smallest id of its class.

    ``block`` is how many texts of an open bucket one side of a comparison holds; it sets
    the memory of a task, never the result.
    """
    table = written(sketches(docs, id_col, text_col), "sketches")
    known = table.where("n > 0 AND doc_id IS NOT NULL")
    exact = written(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")), "exact")
    n_docs = int(exact.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    first = known.join(exact.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")

    placed = first.select(F.col("doc_id").alias("rep"), F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = (placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("pivot"),
                                           F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("s2"))
              .where("c > 1").groupBy("c", "pivot", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "c", "pivot"))
    shared = written(shared, "buckets")
    total = int(shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    members = written(join_hot_safe(placed, shared, ["bucket"], "c", total).select("bucket", "rep", "pivot"), "members")
    pairs = written(members.where("rep <> pivot").select("rep", "pivot").distinct(), "pairs")
    involved = pairs.select("rep").union(pairs.select("pivot")).distinct().hint("merge")     # grows with the table
    words = written(first.select(F.col("doc_id").alias("rep"), "words").join(involved, "rep", "left_semi")
                    .dropDuplicates(["rep"]), "words")
    links = written(verify_pairs(pairs, words, threshold), "links")

    # buckets in which somebody isn't similar to the pivot, in full
    unlike = written(pairs.join(links.select(F.col("a").alias("rep"), F.col("b").alias("pivot")), ["rep", "pivot"], "left_anti"), "unlike-pairs")
    failed = written(members.join(unlike, ["rep", "pivot"], "left_semi").select("bucket", "rep"), "unlike-members")
    counts = (members.join(failed.select("bucket").distinct(), "bucket", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 2"))
    counts = written(counts, "open-buckets")
    again = int(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    size = F.floor(F.log(F.octet_length("words") / 4.0) / F.log(F.lit(1 / threshold))).cast("int")
    inside = join_hot_safe(members.select("bucket", "rep"), counts, ["bucket"], "c", again).select("bucket", "rep")
    full = (inside.join(failed.distinct().withColumn("_open", F.lit(True)), ["bucket", "rep"], "left")
            .select("bucket", "rep", F.col("_open").isNull().alias("ok")).join(words, "rep")
            .withColumn("band", F.explode(F.array(size, size + 1))))

    # a band holds a pair to check only if somebody in it is still open
    open_one = F.max((~F.col("ok")).cast("int"))
    bands = full.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("words") / 4).alias("w"), open_one.alias("o"))
    blocks = F.ceil(F.greatest(F.col("c") / block, F.col("w") / BLOCK_WORDS)).cast("int")
    bands = written(bands.where("c > 1 AND o = 1").select("bucket", "band", "c", blocks.alias("blocks")), "open-bands")
    in_bands = int(bands.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    dealt = (join_hot_safe(full, bands, ["bucket", "band"], "c", in_bands)
             .withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", "band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "rep", "ok", "mine", "words"))

    def examine(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["ok"].all():
            return pd.DataFrame({"a": [], "b": []})
        pdf = pdf.sort_values("rep")
        side = None if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else pdf["mine"].to_numpy()
        got = group_links(pdf["rep"].tolist(), [_shingles_of(w) for w in pdf["words"]], pdf["ok"].tolist(), threshold, side)
        return pd.DataFrame(got, columns=["a", "b"])
    rest = dealt.groupBy("bucket", "band", "lo", "hi").applyInPandas(examine, "a long, b long")
    links = links.unionByName(written(rest, "links"))

    facts = exact.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", "rep", F.coalesce("root", "rep").alias("root"), "c")
    narrow = table.select("doc_id", "k1", "k2", "n")
    in_class = join_hot_safe(narrow.where("n > 0 AND doc_id IS NOT NULL"), facts, ["k1", "k2"], "c", n_docs)
    alone = narrow.where("n = 0 OR doc_id IS NULL")
    return in_class.select("doc_id", F.col("root").alias("class_id"), F.col("rep").alias("copy_of"), F.col("n").alias("n_shingles")).unionByName(
        alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.col("n").alias("n_shingles")))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class (that of the smallest id); rows of NULL id stay."""
    keep = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_keep")).distinct()
    ident = F.col(f"`{id_col}`")
    first = docs.where(ident.isNotNull()).join(keep, ident == F.col("_keep"), "left_semi").dropDuplicates([id_col])
    return first.unionByName(docs.where(ident.isNull()))
