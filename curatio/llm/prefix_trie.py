"""Prefix trie of conversations by double arrays, one per shard, shared upper nodes merged.

A node is a distinct sequence of first turns; its members are the conversations that start
with it.  For each node: smallest member, depth, parent, members, children, childless nodes
below it, what sharing the prefixes below it saves, and a digest of the conversations that
end there.

Jobs:
1. Turns become two 64-bit hashes of (role, text) and a length; the texts don't travel.  The hashes
   of a conversation are gathered in order (20 bytes a turn, so its length is bounded
   by what a row can hold, some ten million turns).
2. Equal conversations form one row (count, smallest id).  The ids of equal conversations are
   range-partitioned by (conversation, id), joined to texts of up to ``CHUNK`` ids where they lie, and a
   stream over these texts hashes them in order: SHA-256 can only be had in sequence, so
   this is the one step that a group goes through in one task, at 1 / ``CHUNK`` of its rows
   and in constant memory.
3. Different conversations are range-partitioned by their sequence: a shard is a range of
   neighbouring sequences, however common a first turn is.  In a shard the turns get dense ids,
   the trie is packed into BASE and CHECK (child of state s by turn t: state BASE[s] + t, if
   CHECK of that is s), and all conversations walk it turn by turn for the aggregates.
4. Only prefixes of a shard's first or last sequence can have members in another shard.  These
   upper nodes are merged by the digest of their path: counts add up, the smallest id
   is kept, and what lies below them is added to all their ancestors.  All other nodes
   are final.

Edge cases: a NULL role or text is empty; NULL turns come first, turns of equal number are ordered by
their hashes, repeated rows are turns of their own; rows of NULL conv_id take no part; a conversation
without turns ends at the root; very long texts are only hashed and counted; an empty table
gives no rows.  Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import crc32_sql, join_hot_safe, written

CHUNK = 4096
SHARD_TURNS = 100_000       # turns of a shard, about
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq) with the turns of each conversation in order: array of (a, b, chars)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).alias("chars"))
    return (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "chars"))).alias("s"))
            .selectExpr("conv_id", "transform(s, x -> struct(x.a, x.b, x.chars)) AS seq"))


class DoubleArray:
    """A trie over sequences of dense ids (0 .. m - 1), packed into BASE and CHECK.

    State 0 is the root; the child of state s by id t is BASE[s] + t, if CHECK there is s.
    """

    def __init__(self, size: int) -> None:
        self.base = np.zeros(max(16, size), np.int64)
        self.check = np.full(max(16, size), -1, np.int64)
        self.check[0] = 0
        self.free = np.arange(max(16, size) + 1)        # the next free slot, by path halving
        self.free[0] = 1
        self.end = 1                                    # no slot from here on is taken

    def _grow(self, size: int) -> None:
        if size <= len(self.base):
            return
        old, new = len(self.base), max(size, 2 * len(self.base))
        self.base = np.concatenate([self.base, np.zeros(new - old, np.int64)])
        self.check = np.concatenate([self.check, np.full(new - old, -1, np.int64)])
        self.free = np.concatenate([self.free, np.arange(old + 1, new + 1)])

    def _next_free(self, s: int) -> int:
        f = self.free
        while s < self.end and f[s] != s:
            f[s] = f[f[s]] if f[s] < len(f) else f[s]
            s = int(f[s])
        return s

    def add_children(self, state: int, ids: np.ndarray) -> np.ndarray:
        """Places the children of ``state`` (ids ascending) and returns their states."""
        lowest, top = int(ids[0]), int(ids[-1])
        at = self._next_free(lowest + 1)
        for _ in range(32):
            base = at - lowest
            self._grow(base + top + 2)
            if len(ids) == 1 or (self.check[base + ids] < 0).all():
                break
            at = self._next_free(at + 1)
        else:
            base = self.end         # nothing is taken there
            self._grow(base + top + 2)
        slots = base + ids
        self.base[state] = base
        self.check[slots] = state
        self.free[slots] = slots + 1
        self.end = max(self.end, base + top + 1)
        return slots

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states after one more turn; all these children must exist."""
        to = self.base[states] + ids
        if (self.check[to] != states).any():
            raise KeyError("no such child")
        return to


def build(lengths: np.ndarray, codes: np.ndarray, m: int) -> tuple[DoubleArray, np.ndarray, np.ndarray]:
    """(trie, state of each turn of each sequence, last state of each sequence)."""
    trie = DoubleArray(len(codes) + m + 2)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    now = np.zeros(len(lengths), np.int64)
    states = np.zeros(len(codes), np.int64)
    for d in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > d)
        ids = codes[starts[on] + d]
        order = np.lexsort((ids, now[on]))
        parent, child = now[on][order], ids[order]
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (child[1:] != child[:-1])])
        parent, child = parent[new], child[new]
        firsts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])).tolist()
        for a, b in zip(firsts, [*firsts[1:], len(parent)], strict=True):
            trie.add_children(int(parent[a]), child[a:b])
        now[on] = states[starts[on] + d] = trie.step(now[on], ids)
    return trie, states, now


_NODE = ("path string, parent_path string, above array<string>, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, chars long, ends string")


def _prefix_paths(a: np.ndarray, b: np.ndarray) -> list[str]:
    """Digests of all prefixes of a sequence, the empty one first."""
    h = hashlib.sha256()
    out = [h.hexdigest()[:32]]
    for x, y in zip(a, b, strict=True):
        h.update(x.tobytes() + y.tobytes())
        out.append(h.hexdigest()[:32])
    return out


def _shard_nodes(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, chars: np.ndarray, n: np.ndarray, rep: np.ndarray,
                 ends: list[str]) -> pa.RecordBatch:
    """The nodes of one shard, whose sequences are different and sorted."""
    pairs = np.empty(len(a), [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = a, b
    _, first, codes = np.unique(pairs, return_index=True, return_inverse=True)
    trie, states, last = build(lengths, codes.astype(np.int64), len(first))
    stop = np.cumsum(lengths)
    start = stop - lengths
    size = len(trie.check)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    depth, members = np.zeros(size, np.int64), np.zeros(size, np.int64)
    smallest = np.full(size, np.iinfo(np.int64).max)
    depth[states] = np.arange(len(codes)) - np.repeat(start, lengths) + 1
    np.add.at(members, states, n[owner])
    np.minimum.at(smallest, states, rep[owner])
    members[0], smallest[0] = n.sum(), rep.min()
    own = np.flatnonzero(trie.check >= 0)
    own = own[np.argsort(depth[own], kind="stable")]            # the root first
    below = own[1:]
    parent = trie.check[below]
    length = np.zeros(size, np.int64)
    length[states] = chars
    kids = np.bincount(parent, minlength=size)

    upper = np.zeros(size, bool)
    paths: dict[int, tuple[str, list[str]]] = {}
    for i in (0, len(lengths) - 1):
        p = _prefix_paths(a[start[i]:stop[i]], b[start[i]:stop[i]])
        for d, s in enumerate([0, *states[start[i]:stop[i]].tolist()]):
            upper[s] = True
            paths[s] = (p[d], p[:d + 1])
    leaves = np.where(upper, 0, kids == 0).astype(np.int64)
    saved = np.where(upper, 0, (members - 1) * length)
    for d in range(int(depth.max()), 0, -1):                    # final nodes count for their parents
        at = below[(depth[below] == d) & ~upper[below]]
        np.add.at(leaves, trie.check[at], leaves[at])
        np.add.at(saved, trie.check[at], saved[at])
    final_kids = np.bincount(parent[~upper[below]], minlength=size)
    ended = dict(zip(last.tolist(), ends, strict=True))
    of = trie.check
    rows = own.tolist()
    above_final = [bool(x) for x in (~upper[of[own]]) & (own != 0)]
    return pa.RecordBatch.from_arrays([
        pa.array([paths[s][0] if s in paths else None for s in rows], pa.string()),
        pa.array([paths[p][0] if s and (p := int(of[s])) in paths else None for s in rows], pa.string()),
        pa.array([paths[s][1] if s in paths else None for s in rows], pa.list_(pa.string())),
        pa.array(smallest[own]), pa.array(depth[own]), pa.array(smallest[of[own]], mask=~np.array(above_final)), pa.array(members[own]),
        pa.array(np.where(upper, final_kids, kids)[own]), pa.array(leaves[own]), pa.array(saved[own]), pa.array(length[own]),
        pa.array([ended.get(s) for s in rows], pa.string())],
        ["path", "parent_path", "above", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends"])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: the batches of a partition, sorted by sequence."""
    parts, ends = [], []
    for batch in batches:
        seq = batch.column(0)
        turns = seq.flatten()
        parts.append([seq.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                      *[turns.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)],
                      *[batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]])
        ends += batch.column(3).to_pylist()
    if not ends:
        return
    nodes = _shard_nodes(*[np.concatenate(x) for x in zip(*parts, strict=True)], ends)
    for i in range(0, nodes.num_rows, 10_000):
        yield nodes.slice(i, 10_000)


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows as (key, first id, text of up to ``CHUNK`` ids)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0]
        for i in range(1, len(key)):
            if key[i] != key[i - 1] or i - cuts[-1] == CHUNK:
                cuts.append(i)
        ends = [*cuts[1:], len(key)]
        yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in cuts]), pa.array([ids[i] for i in cuts]),
                                          pa.array([",".join(map(str, ids[i:j])) for i, j in zip(cuts, ends, strict=True)])], ["key", "first", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts, joined by commas, over rows sorted by (key, first id)."""
    key, h = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                h.update(b"," + text.encode())
                continue
            if h is not None:
                done.append((key, h.hexdigest()))
            key, h = k, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])


def trie_nodes(convs: DataFrame) -> DataFrame:
    """Every node of the trie over ``convs`` (conv_id, seq); see the module's docstring for the columns."""
    spark = convs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    table = written(convs.selectExpr("conv_id", "seq", "md5(array_join(transform(seq, x -> concat(x.a, ':', x.b)), ',')) AS key"), "conversations")
    kinds = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"))
    ordered = table.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = ordered.mapInArrow(_id_texts, "key string, first long, ids string")
    ends = texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_id_digests, "key string, ends string")
    firsts = table.select(F.col("conv_id").alias("rep"), "seq").join(kinds, "rep").join(ends, "key").select("seq", "n", "rep", "ends")
    firsts = written(firsts, "distinct-conversations")
    turns = firsts.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0))).first()[0]
    shards = firsts.repartitionByRange(max(parts, turns // SHARD_TURNS), "seq").sortWithinPartitions("seq")
    found = written(shards.mapInArrow(_shard, _NODE), "trie-nodes")

    merged = written(found.where("path IS NOT NULL").groupBy("path").agg(
        F.first("parent_path").alias("parent_path"), F.first("above").alias("above"), F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.first("chars").alias("chars"), F.max("ends").alias("ends")), "upper-nodes")
    inner = merged.where("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(inner, "path", "left").withColumn("kids", F.col("n_children") + F.coalesce("more", F.lit(0)))
    sums = merged.selectExpr("explode(above) AS path", "n_leaves + int(kids = 0) AS l", "saved_tokens + (n_convs - 1) * chars AS s").groupBy("path").agg(
        F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    parents = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    top = (merged.drop("n_leaves", "saved_tokens", "n_children").join(sums, "path").join(parents, "parent_path", "left")
           .selectExpr("conv_id", "depth", "parent_id AS parent_conv_id", "n_convs", "kids AS n_children", "n_leaves", "saved_tokens", "ends"))
    final = found.where("path IS NULL")
    known = final.where("parent_path IS NULL").select(*out)
    # a parent's children may be a third of all nodes
    counted = merged.where("n_children > 0").select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_id"), F.col("n_children").alias("w"))
    hanging = final.where("parent_path IS NOT NULL").drop("path", "above")
    total = merged.agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    hung = join_hot_safe(hanging, counted, ["parent_path"], "w", int(total)).withColumn("parent_conv_id", F.col("parent_id")).select(*out)
    return top.unionByName(known).unionByName(hung).withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))


def oracle_sql() -> str:
    """DuckDB SQL for ``op12_prefix_trie`` (ids and turns without ties)."""
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.head AND t.i <= c.h
      UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, md5(length(role) || ':' || role || text) AS m, length(text) AS chars FROM b),
p AS (SELECT conv_id, d, chars, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM p GROUP BY path),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
last AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
ends AS (SELECT path, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN last ON last.conv_id = p.conv_id AND last.d = p.d GROUP BY path),
sub AS (SELECT left(x.path, 32 * x.a) AS path, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.chars) AS saved
        FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM node) x LEFT JOIN kids ON kids.path = x.path GROUP BY 1)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.k, 0) AS n_children,
  CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node JOIN sub ON sub.path = node.path LEFT JOIN kids ON kids.path = node.path LEFT JOIN ends ON ends.path = node.path
LEFT JOIN node up ON node.depth > 0 AND up.path = left(node.path, 32 * (node.depth - 1))"""
