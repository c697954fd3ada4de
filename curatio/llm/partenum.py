"""Similarity join of shingle sets by PartEnum signatures; exact Jaccard, connected classes.

A text's words (between ASCII blanks, A-Z lower-cased) give the set of its distinct 5-word
shingles, as 64-bit hashes.  Two sets are linked when ``100 * |A & B| >= percent * |A | B|``.

Signatures.  Sizes are cut into bands [l, r] with r = l * 100 // percent; similar sets lie in
the same band or in neighbouring ones.  Instance j serves pairs whose smaller set is in band j,
and both bands j and j + 1 take part.  Their sets differ in at most k = r_j * (100 - percent) //
percent elements.  The instance hashes the feature domain into n1 partitions of three parts
each.  With n1 > k // 2 partitions, one has at most one part that differs, so the two other
parts agree: each of the three pairs of parts of each partition is a signature (the hash of
the set's elements in them), and similar sets share at least one.  A signature of empty parts
says nothing and is left out if the set has more than k // 2 partitions without empty pairs,
since one of those agrees then; otherwise the set keeps its empty signatures too.  So
no pair is lost.  Sets of instances with k = 0 could only be equal, and equal sets are one.

Who takes part.  An element that one set alone has is a difference in every pair, so a set of
which over 100 - percent in a hundred of the elements are its own has no partner.  Elements
whose hash ends below 3 (decimal) are counted over all sets; a set with more own ones among
these than it may have at all is left out.  This loses nothing, and leaves few sets of a table
in which most texts are unlike all others.

Jobs:
1. One pass over the texts writes size, digest and the counted elements of each set.
2. Equal sets are one (smallest id); own elements are counted: blocks of elements (48 bits) with the tags
   (32 bits) of their sets are dealt by element, blocks of own elements' tags by tag.  Elements that agree
   in 48 bits count as shared, and sets that agree in the tag take part anyway, so no link is lost.
3. The remaining sets are read again and written.
4. A signature of several sets is a bucket; buckets of equal members count once.  Signatures (46 bits and
   more) and ids travel packed, once, dealt by signature; signatures of one set go no further.  Sets whose
   signatures agree in these bits are compared, so no pair is lost.  A signature that a block of sets
   repeats often, or that has very many members, leaves its task in pieces.  Each member is
   compared with the bucket's smallest id; intersections are counted from the arrays.
5. Connected components of the links.  Where a bucket's members lie in different components,
   those outside its largest one are compared with all others, in blocks of bounded size, by
   parity bits (half a byte an element) that give a lower bound of the difference; the pairs
   that they leave are verified as in 4.  Buckets of one smallest id have mostly the same members:
   they are compared together, so that a member's bits travel once for many buckets.  A bucket of m
   mutually unlike sets costs m * m / 2 comparisons of bits, over many tasks.
6. Components again, if that found links.

Edge cases: NULL, empty and blank texts have no shingles and are their own component; texts of 1 to
4 words have one shingle, the whole sequence; rows of NULL id take no part and get a NULL
component; repeated rows share a component, and rows of equal id with different texts count as
one document's; very long texts give large sets, each compared whole; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.chunks import ChunkTable, ragged, shared_table
from curatio.llm.common import components, id_and_text, join_hot_safe, text_slices, written

K, PERCENT = 5, 80
GROUP = 256                             # pairs of one pivot that one group compares
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 19   # sets and elements of one block of a mixed bucket
UNITED = 32                             # times as much that the mixed buckets examined together may hold
MAX_BROADCAST_SETS = 500_000            # ids of sets read again: 8 MB, about 40 MB as a hash relation
PARTS = 3
UNIT = ["unit", "chunk", "lo", "hi"]    # sets compared together
ELEMENT_BYTES, TAG_BYTES = 6, 4         # of an element and of a set while own elements are counted
SIGNATURE_BYTES = 5                     # of a signature, besides its part
BLOCK_COUNTED = 500_000                 # elements or signatures of sets that one task deals out at a time
PART_COUNTED, LEAST_PARTS = 1 << 20, 64     # elements or signatures that one task counts, and the least number of such parts
OFTEN = 64                              # members of a signature in one block; more go by themselves
MOST_MEMBERS = 4096                     # members of a signature in one row
_R = np.random.default_rng(11)
_STEP = _R.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _nth(j: int, seed: int) -> np.uint64:
    return np.uint64(j * int(_STEP[seed]) & 0xFFFFFFFFFFFFFFFF)


def _word_table() -> ChunkTable:
    def values(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return ragged([[xxhash.xxh3_64_intdigest(c.encode("utf-8", "surrogatepass").lower())] for c in chunks], np.uint64)
    return shared_table("words64", lambda: ChunkTable(values, np.uint64, limit=100_000))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a sequence of word hashes, ascending."""
    if not len(words):
        return words
    k = min(K, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s += words[i:i + n] * _STEP[i]
    return np.unique(_mix(s))


def bands(up_to: int, percent: int) -> list[int]:
    """Largest size of each band, until one holds ``up_to``."""
    out = [100 // percent]
    while out[-1] < up_to:
        out.append((out[-1] + 1) * 100 // percent)
    return out


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signed 64-bit signatures of a set, for its band's instance and the one below."""
    ends = bands(len(s), percent)
    out = []
    for j in (len(ends) - 1, len(ends) - 2):
        k = ends[j] * (100 - percent) // percent if j >= 0 else 0
        if k == 0:
            continue
        n1 = (5 * (k // 2 + 1) + 3) // 4 + 1
        at = (_mix(s + _nth(j, 6)) % np.uint64(PARTS * n1)).astype(np.int64)
        total = np.zeros(PARTS * n1, np.uint64)
        np.add.at(total, at, _mix(s * _STEP[5] + np.uint64(1)))
        count = np.bincount(at, minlength=PARTS * n1).reshape(n1, PARTS)
        total = total.reshape(n1, PARTS)
        name = _mix(np.arange(n1 * PARTS, dtype=np.uint64) + _nth(j, 7)).reshape(n1, PARTS)
        pair = np.stack([total[:, (e + 1) % PARTS] * _STEP[0] + total[:, (e + 2) % PARTS] * _STEP[1] for e in range(PARTS)], axis=1)
        full = np.stack([count[:, (e + 1) % PARTS] + count[:, (e + 2) % PARTS] > 0 for e in range(PARTS)], axis=1)
        keep = full if np.count_nonzero(full.all(axis=1)) > k // 2 else np.ones_like(full)
        out.append(_mix(pair + name)[keep])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of elements falls into each of 2**i >= 4 * size cells, as bits.

    Every element that two sets don't share changes one bit of one of them, so the sets differ in
    at least as many elements as their bits differ.
    """
    cells = max(64, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((_mix(s * _STEP[4]) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(parities: list[bytes]) -> np.ndarray:
    """The bits of all sets at the smallest number of cells among them, one row of 64-bit words each."""
    least = min(map(len, parities))
    out = np.empty((len(parities), least), np.uint8)
    for i, p in enumerate(parities):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, least), axis=0)
    return out.view(np.uint64)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    table = _word_table()
    for part, texts in text_slices(batches):
        flat, counts = table.rows(texts)
        ends = np.cumsum(counts)
        yield part, [shingle_set(flat[e - c:e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, counted) of each row of (doc_id, text): the set's size, digest and counted elements."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets_of(batches):
            d = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets]
            k1, k2 = ([int.from_bytes(x[i:i + 8], "little", signed=True) for x in d] for i in (0, 8))
            counted = [_packed(s[s % np.uint64(10) < 3] >> np.uint64(64 - 8 * ELEMENT_BYTES), ELEMENT_BYTES) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(counted, pa.binary())], ["doc_id", "n", "k1", "k2", "counted"])
    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, counted binary")


def _packed(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _extremes(e: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct elements, with the smallest and the largest of their tags."""
    order = np.lexsort((tags, e))
    e, tags = e[order], tags[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(e)), bool), e[1:] != e[:-1]]))
    return e[first], tags[first], tags[np.append(first[1:], len(e))[:len(first)] - 1]


def _dealt(key: np.ndarray, parts: int, **packed: tuple[np.ndarray, int]) -> pa.RecordBatch:
    """One row (part, ...) for each part of the keys, with the packed numbers that belong to it."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts), "right")
    starts = np.append(0, ends[:-1])
    have = np.flatnonzero(ends > starts)
    cols = [pa.array([_packed(x[order[a:b]], width) for a, b in zip(starts[have].tolist(), ends[have].tolist(), strict=True)], pa.binary()) for x, width in packed.values()]
    return pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), *cols], ["part", *packed])


def own_elements(known: DataFrame, parts: int) -> DataFrame:
    """(tag, u): how many counted elements the sets of a tag, rows (k1, counted), share with no other tag.

    Of an element no more than two tags travel from one block.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            e, low, high = _extremes(np.concatenate(sets), np.repeat(np.array(tags, np.uint64), [len(x) for x in sets]))
            two = low != high
            e = np.concatenate([e, e[two]])
            return _dealt(e, parts, elements=(e, ELEMENT_BYTES), tags=(np.concatenate([low, high[two]]), TAG_BYTES))
        sets, tags, n = [], [], 0
        for batch in batches:
            for k1, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sets.append(_unpacked(data, ELEMENT_BYTES))
                tags.append(k1 & 0xFFFFFFFF)
                n += len(sets[-1])
                if n >= BLOCK_COUNTED:
                    yield block()
                    sets, tags, n = [], [], 0
        if sets:
            yield block()

    def numbers(table: pa.Table, column: str, width: int) -> np.ndarray:
        return _unpacked(b"".join(table.column(column).to_pylist()), width)

    def alone(table: pa.Table) -> pa.Table:
        _, low, high = _extremes(numbers(table, "elements", ELEMENT_BYTES), numbers(table, "tags", TAG_BYTES))
        tag, u = np.unique(low[low == high], return_counts=True)
        times = -(-u // 255)            # a number above 255 is several
        last = np.cumsum(times) - 1
        u_of = np.full(int(times.sum()), 255, np.uint64)
        u_of[last] = u - 255 * (times - 1)
        tag = np.repeat(tag, times)
        return pa.Table.from_batches([_dealt(tag, parts, tags=(tag, TAG_BYTES), us=(u_of, 1))])

    def summed(table: pa.Table) -> pa.Table:
        tag, at = np.unique(numbers(table, "tags", TAG_BYTES), return_inverse=True)
        u = np.zeros(len(tag), np.int64)
        np.add.at(u, at, numbers(table, "us", 1).astype(np.int64))
        return pa.table({"tag": tag.astype(np.int64), "u": u})

    dealt = known.select("k1", "counted").mapInArrow(blocks, "part long, elements binary, tags binary")
    return (dealt.groupBy("part").applyInArrow(alone, "part long, tags binary, us binary")
            .groupBy("part").applyInArrow(summed, "tag long, u long"))


def kept_sets(docs: DataFrame) -> DataFrame:
    """(rep, n, elements, parity) of each row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets_of(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([parity(s) for s in sets], pa.binary())], ["rep", "n", "elements", "parity"])
    return docs.mapInArrow(run, "rep long, n long, elements array<long>, parity binary")


def _runs(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, sorted, and where the run of each key starts and ends."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids = key[new], ids[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key, ids, starts, np.append(starts[1:], len(key))[:len(starts)]


def shared_signatures(sets: DataFrame, low: int, high: int, parts: int, percent: int,
                      block: int = BLOCK_COUNTED, often: int = OFTEN, most: int = MOST_MEMBERS) -> DataFrame:
    """(bucket, reps, whole): the sets, rows (rep, elements) with ids from ``low`` to ``high``, of each signature that several have.

    ``whole`` rows hold all members, ascending; of equal ones a task returns one.  The others are pieces, and may repeat a member.
    """
    width = max(1, ((high - low).bit_length() + 7) // 8)
    base, of = np.uint64(low & 0xFFFFFFFFFFFFFFFF), np.uint64(parts)
    kinds = {"part": pa.int64(), "signatures": pa.binary(), "ids": pa.binary(), "often": pa.binary(), "bucket": pa.int64()}

    def name(part: int, key: np.ndarray) -> np.ndarray:
        return (key * of + np.uint64(part)).view(np.int64)

    def pieces(part: int, key: np.uint64, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(0, len(ids), most):
            yield int(name(part, np.array([key]))[0]), ids[i:i + most]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal() -> Iterator[pa.RecordBatch]:
            s, ids, starts, ends = _runs(np.concatenate(found), np.repeat(np.array(reps, np.int64).view(np.uint64) - base, [len(x) for x in found]))
            hot = np.flatnonzero(ends - starts > often)
            stay, rows = np.ones(len(s), bool), []
            for a, b in zip(starts[hot].tolist(), ends[hot].tolist(), strict=True):     # two show that it is shared
                stay[a + 2:b] = False
                for bucket, x in pieces(int(s[a] % of), s[a] // of & mask, ids[a + 2:b]):
                    rows.append({"part": -1 - int(_mix(x[:1] + np.uint64(bucket & 0xFFFFFFFFFFFFFFFF))[0] % of), "ids": _packed(x, width), "bucket": bucket})
            s, ids, hot = s[stay], ids[stay], s[starts[hot]]
            for row in (_dealt(s, parts, signatures=(s // of, SIGNATURE_BYTES), ids=(ids, width)), _dealt(hot, parts, often=(hot // of, SIGNATURE_BYTES))):
                rows += row.to_pylist()
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
        found, reps, n = [], [], 0
        for batch in batches:
            ends, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().view(np.uint64)
            for rep, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found.append(signatures(values[a:b], percent).view(np.uint64))
                reps.append(rep)
                n += len(found[-1])
                if n >= block:
                    yield from deal()
                    found, reps, n = [], [], 0
        if n:
            yield from deal()

    def members(table: pa.Table) -> pa.Table:
        def column(c: str) -> bytes:
            return b"".join(x for x in table.column(c).to_pylist() if x)
        part, rows = table.column("part")[0].as_py(), []
        if part < 0:
            rows = [(b, _unpacked(x, width), False) for b, x in zip(table.column("bucket").to_pylist(), table.column("ids").to_pylist(), strict=True)]
        else:
            key, ids, starts, ends = _runs(_unpacked(column("signatures"), SIGNATURE_BYTES), _unpacked(column("ids"), width))
            several = np.flatnonzero(ends - starts > 1)
            starts, ends = starts[several], ends[several]
            whole = (ends - starts <= most) & ~np.isin(key[starts], _unpacked(column("often"), SIGNATURE_BYTES))
            seen = set()
            for a, b, w, bucket in zip(starts.tolist(), ends.tolist(), whole.tolist(), name(part, key[starts]).tolist(), strict=True):
                if not w:
                    rows += [(bucket, x, False) for _, x in pieces(part, key[a], ids[a:b])]
                elif (same := ids[a:b].tobytes()) not in seen:
                    seen.add(same)
                    rows.append((bucket, ids[a:b], True))
        values = np.concatenate([np.zeros(0, np.uint64), *(x for _, x, _ in rows)]) + base
        offsets = np.cumsum([0, *(len(x) for _, x, _ in rows)])
        return pa.table({"bucket": pa.array([b for b, _, _ in rows], pa.int64()), "reps": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))),
                         "whole": pa.array([w for _, _, w in rows], pa.bool_())})

    mask = np.uint64((1 << 8 * SIGNATURE_BYTES) - 1)
    dealt = sets.select("rep", "elements").mapInArrow(blocks, "part long, signatures binary, ids binary, often binary, bucket long")
    return dealt.groupBy("part").applyInArrow(members, "bucket long, reps array<long>, whole boolean")


def bucket_members(found: DataFrame) -> DataFrame:
    """(bucket, rep, pivot) of the rows of ``shared_signatures``: each bucket's members with the smallest; buckets of equal members count once."""
    whole = found.where("whole").groupBy("reps").agg(F.min("bucket").alias("bucket")).selectExpr("bucket", "explode(reps) AS rep", "reps[0] AS pivot")
    if found.where("NOT whole").isEmpty():
        return whole
    placed = found.where("NOT whole").selectExpr("bucket", "explode(reps) AS rep").distinct()
    shared = (placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("pivot"), F.bit_xor(F.xxhash64("rep")).alias("s1"),
                                           F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("s2"))
              .groupBy("c", "pivot", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "c", "pivot"))
    shared = written(shared, "buckets")
    total = shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return whole.unionByName(join_hot_safe(placed, shared, ["bucket"], "c", int(total)).select("bucket", "rep", "pivot"))


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (rep, pivot, part) of rows (rep, pivot, part, n, parity, n2, p2) that the bits don't rule out."""
    for batch in batches:
        n, n2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
        apart = [int(np.bitwise_count(x[0] ^ x[1]).sum(dtype=np.int64))
                 for x in map(_folded, zip(batch.column(4).to_pylist(), batch.column(6).to_pylist(), strict=True))]
        keep = (100 + percent) * np.array(apart, np.int64) <= (100 - percent) * (n + n2)
        yield batch.select([0, 1, 2]).filter(pa.array(keep))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (rep, pivot) that are similar, as (a, b).

    The parity bits rule out most others; the rest is counted from the elements.  A pivot's
    pairs are dealt into parts of about ``GROUP``, each with a copy of the pivot's set.
    """
    sizes = written(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")), "pivots")
    total = sizes.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    dealt = join_hot_safe(pairs, sizes, ["pivot"], "c", int(total)).selectExpr("rep", "pivot", f"pmod(xxhash64(rep), ceil(c / {GROUP})) AS part")
    parts = sizes.selectExpr("pivot", f"explode(sequence(0L, ceil(c / {GROUP}) - 1)) AS part")
    both = dealt.join(sets.select("rep", "n", "parity"), "rep").join(
        parts.join(sets.selectExpr("rep AS pivot", "n AS n2", "parity AS p2"), "pivot"), ["pivot", "part"])
    both = both.where(f"100 * least(n, n2) >= {percent} * greatest(n, n2)").select("rep", "pivot", "part", "n", "parity", "n2", "p2")
    near = written(both.mapInArrow(lambda it: _near(it, percent), "rep long, pivot long, part long"), "near-pairs")
    exact = near.join(sets.select("rep", "n", "elements"), "rep").join(
        parts.join(near.select("pivot", "part").distinct(), ["pivot", "part"], "left_semi").join(
            sets.selectExpr("rep AS pivot", "n AS n2", "elements AS e2"), "pivot"), ["pivot", "part"])
    return exact.where(f"{100 + percent} * size(array_intersect(elements, e2)) >= {percent} * (n + n2)").selectExpr("rep AS a", "pivot AS b")


def candidates(sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray, side: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of different components, and different sides, that the bits don't rule out.

    The members of the most frequent component aren't compared with each other.
    """
    kinds, group, often = np.unique(roots, return_inverse=True, return_counts=True)
    main = int(often.argmax())
    for i in np.flatnonzero(group != main).tolist():
        other = (group != group[i]) & ((group == main) | (np.arange(len(sizes)) > i))
        if side is not None:
            other &= side != side[i]
        j = np.flatnonzero(other)
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        j = j[(100 + percent) * apart <= (100 - percent) * (sizes[j] + sizes[i])]
        if len(j):
            yield np.full(len(j), i), j


def _group_pairs(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``candidates`` of each bucket of each (unit, chunk, lo, hi) of a frame sorted by these."""
    key, ids, roots, sizes, mine = (pdf[c].to_numpy() for c in (UNIT, "rep", "root", "n", "mine"))
    parities, buckets = pdf["parity"].tolist(), pdf["buckets"].tolist()
    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
    found = [np.zeros((2, 0), np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2 or (roots[a:b] == roots[a]).all():
            continue
        bucket, who = np.concatenate(buckets[a:b]), np.repeat(np.arange(a, b), [len(x) for x in buckets[a:b]])
        order = np.argsort(bucket, kind="stable")
        for at in np.split(who[order], np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(at) > 1 and (roots[at] != roots[at[0]]).any():
                side = None if key[a, 2] == key[a, 3] else mine[at]
                for i, j in candidates(sizes[at], _folded([parities[x] for x in at.tolist()]), roots[at], side, percent):
                    found.append(np.stack([ids[at[i]], ids[at[j]]]))
    x = np.concatenate(found, axis=1)
    return pd.DataFrame({"rep": x.max(axis=0), "pivot": x.min(axis=0)}).drop_duplicates()


def mixed_units(members: DataFrame, roots: DataFrame, sets: DataFrame, block: int = BLOCK, united: int = UNITED) -> DataFrame:
    """(unit, chunk, lo, hi, mine, rep, root, buckets): sets that are compared together, in buckets whose members lie in different components.

    A bucket of one block is examined with others of its smallest id, up to ``united`` times a
    block's sets and elements; of a larger one, each pair of blocks is a unit.
    """
    facts = (sets.groupBy("rep").agg(F.max("n").alias("n")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .selectExpr("rep", "n", "coalesce(root, rep) AS root"))
    at = written(members.join(facts, "rep").select("bucket", "pivot", "rep", "root", "n"), "bucket-roots")
    mixed = (at.groupBy("bucket").agg(F.min("pivot").alias("pivot"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("root").alias("r1"), F.max("root").alias("r2"))
             .where("r1 <> r2 AND c > 2").selectExpr("*", f"int(ceil(greatest(c / {block}, w / {BLOCK_ELEMENTS}))) AS blocks"))
    small = "sum(if(blocks = 1, {}, 0)) OVER (PARTITION BY pivot)".format
    mixed = mixed.selectExpr("*", f"int(ceil(greatest({small('c')} / {united * block}, {small('w')} / {united * BLOCK_ELEMENTS}))) AS chunks")
    mixed = written(mixed.selectExpr("bucket", "c", "blocks", "if(blocks = 1, pivot, bucket) AS unit", "if(blocks = 1, int(pmod(xxhash64(bucket), chunks)), -1) AS chunk"), "mixed-buckets")
    total = mixed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return (join_hot_safe(at.select("bucket", "rep", "root"), mixed, ["bucket"], "c", int(total)).selectExpr("*", "int(pmod(xxhash64(rep), blocks)) AS mine")
            .selectExpr("*", "explode(sequence(0, blocks - 1)) AS other")
            .selectExpr("unit", "chunk", "least(mine, other) AS lo", "greatest(mine, other) AS hi", "mine", "bucket", "rep", "root")
            .repartition("rep").groupBy(*UNIT, "mine", "rep", "root").agg(F.collect_list("bucket").alias("buckets")))


def mixed_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (rep, pivot) of buckets whose members lie in different components that may be similar."""
    def examine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[UNIT].to_numpy()
            last = int((~(key == key[-1]).all(axis=1)).nonzero()[0].max(initial=-1)) + 1 if len(key) else 0
            rest = pdf.iloc[last:]          # the last group may go on in the next batch
            yield _group_pairs(pdf.iloc[:last], percent)
        if rest is not None:
            yield _group_pairs(rest, percent)
    units = mixed_units(members, roots, sets, block).join(sets.select("rep", "n", "parity"), "rep")
    units = units.select(*UNIT, "mine", "rep", "root", "buckets", "n", "parity").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return units.mapInPandas(examine, "rep long, pivot long").distinct()


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``block`` is how many sets of a mixed bucket one side of a comparison holds; it sets
    the memory of a task, never the result.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    texts = id_and_text(docs, id_col, text_col)
    table = written(digests(texts), "set-digests")
    known = table.where("n > 0 AND doc_id IS NOT NULL")
    exact = written(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c")), "distinct-sets")
    counted = exact.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 3 // 10
    once = own_elements(known, max(LEAST_PARTS, -(-counted // PART_COUNTED)))
    tagged = exact.selectExpr("rep", "n", "k1 & 4294967295L AS tag").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("tag")))
    kept = written(tagged.join(once, "tag", "left").where(F.expr(f"same > 1 OR 100 * coalesce(u, 0) <= {100 - percent} * n")).select(F.col("rep").alias("doc_id")), "sets-with-partners")
    left, low, high = kept.agg(F.count("doc_id"), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    small = left <= MAX_BROADCAST_SETS
    again = texts.join(F.broadcast(kept) if small else kept.hint("merge"), "doc_id", "left_semi")
    if not small:
        again = again.dropDuplicates(["doc_id"])
    sets = written(kept_sets(again), "kept-sets")

    elements = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-4 * elements * (100 - percent) // percent // PART_COUNTED))    # about as many signatures
    found = written(shared_signatures(sets, low, high, parts, percent), "shared-signatures")
    members = written(bucket_members(found), "members")
    pairs = written(members.where("rep <> pivot").select("rep", "pivot").distinct(), "pairs")
    links = written(verified(pairs, sets, percent), "links")
    roots = written(components(links), "roots")
    tried = written(mixed_pairs(members, roots, sets, percent, block).join(pairs, ["rep", "pivot"], "left_anti"), "mixed-pairs")
    more = written(verified(tried, sets, percent), "more-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    facts = exact.drop("n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("k1", "k2", "coalesce(root, rep) AS component_id", "c")
    rows = table.selectExpr("doc_id", "k1", "k2", "n AS n_shingles")
    alone = F.expr("n_shingles = 0 OR doc_id IS NULL")
    found = join_hot_safe(rows.where(~alone), facts, ["k1", "k2"], "c", int(table.count())).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.where(alone).selectExpr("doc_id", "n_shingles", "doc_id AS component_id"))


def oracle_sql() -> str:
    """DuckDB SQL for ``op11_shingle_join`` (unique ids): all pairs with a common shingle, then the closure of their links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {K} THEN list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
          FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= {PERCENT} * (na + nb - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id"""
