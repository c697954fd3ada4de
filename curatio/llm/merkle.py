"""Merkle manifest of a dataset: interval-labelled hash trees, inclusion proofs, verification.

Every row is a leaf: the SHA-256 of its fields.  The leaves of a group, ascending by id, form
a tree: as long as there are several nodes, every ``fanout`` consecutive ones (the last run may
be shorter, even a single one) get the SHA-256 of their digests (hex text, end to end) as
parent.  What remains is the group's subroot; the subroots, ordered by group (NULL first,
bytewise), form a tree in the same way, whose top is the root of the dataset.

Nodes carry labels: the interval [lo, hi) of the leaf ranks they cover.  A node of level j with
rank interval starting at lo lies in bucket ``lo div fanout**j``, so the parent is found in one
bucket of the next level, and is the node there whose interval contains the child's.  The
siblings are what the parent's interval has besides the child's: the nodes left of it
(hi <= child's lo) and right of it (lo >= child's hi).

Jobs:
1. The fields are hashed in the scan; (group, id, digests) is written.
2. Leaves are range-partitioned by (group, id), so that a group of any size spreads over the
   tasks, and numbered by the counted ranges.
3. Tiers of ``BAND`` levels: ``fanout**BAND`` consecutive nodes meet in one group (never more),
   which hashes its part of the next levels; the tops are the units of the next tier.
4. From the root down, each bucket of a tier is joined with the path of the unit that contains
   it, and hands every node below its siblings level by level.

Shuffled are the n leaves twice and n / fanout**BAND units a tier; no path travels with a leaf.

Edge cases: NULL fields hash as ``-``; rows of NULL id come first in their group and are never
taken for tampered; rows of equal id are ordered by digest and equal rows lie next to each
other; a NULL group is a group of its own; a single row is its own subroot and a single group's
subroot is the root (an empty proof); very long texts are hashed where they are read and
don't travel; an empty table gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.common import crc32_sql, written

FANOUT, BAND = 2, 5
MAX_BROADCAST_RANGES = 100_000      # (group, range) rows of a few numbers: about 10 MB


def field(c: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(cols: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def tree_key(group: Column) -> Column:
    """A key without NULL that sorts like the group, NULL first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``lo``: the rank in its tree by ``order``, and ``n``: the tree's size.

    ``rows`` must be a written table: its rows are read twice, once for the range borders.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = ["tree", *order, "_seq"]     # equal rows are dealt over ranges by their place in the table
    s = rows.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    s = written(s.withColumn("_pid", F.spark_partition_id())
                .withColumn("_loc", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("_seq"), "merkle-order")
    ranges = s.groupBy("tree", "_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_loc").alias("_f"))
    whole = Window.partitionBy("tree")
    ranges = written(ranges.select(
        "tree", "_pid", "_f", F.sum("_c").over(whole).alias("n"),
        F.coalesce(F.sum("_c").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")), "merkle-ranges")
    if ranges.count() <= MAX_BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    return s.join(ranges, ["tree", "_pid"]).withColumn("lo", F.col("_off") + F.col("_loc") - F.col("_f")).drop("_pid", "_loc", "_f", "_off")


def _joined(nodes: str) -> str:
    return f"array_join(transform({nodes}, x -> x.digest), '')"


def with_levels(runs: DataFrame, span: int, fanout: int) -> DataFrame:
    """``_l0`` .. ``_l{BAND}``: the nodes of a run level by level; a finished tree stays as it is.

    ``span`` is how many leaves a full unit of the run covers.
    """
    runs = runs.selectExpr("*", "transform(items, x -> struct(x.lo AS lo, x.hi AS hi, x.digest AS digest)) AS _l0")
    for j in range(1, BAND + 1):
        kids = f"slice(_l{j - 1}, i * {fanout} + 1, {fanout})"
        parent = (f"struct(get(_l{j - 1}, i * {fanout}).lo AS lo, element_at({kids}, -1).hi AS hi, sha2({_joined(kids)}, 256) AS digest)")
        up = f"transform(sequence(0, int((size(_l{j - 1}) - 1) div {fanout})), i -> {parent})"
        runs = runs.selectExpr("*", f"CASE WHEN n > {span * fanout ** (j - 1)} THEN {up} ELSE _l{j - 1} END AS _l{j}")
    return runs


def _path_in_run(lo: str, hi: str, span: int, fanout: int) -> str:
    """SQL of the (left, right) siblings' digests of the interval [lo, hi), level by level within its run."""
    steps = []
    for j in range(1, BAND + 1):
        nth = f"int(({lo} - first) div {span * fanout ** j})"
        parent = f"get(_l{j}, {nth})"
        inside = f"filter(slice(_l{j - 1}, {nth} * {fanout} + 1, {fanout}), x -> {parent}.lo <= x.lo AND x.hi <= {parent}.hi)"
        left, right = (_joined(f"filter({inside}, x -> {where})") for where in (f"x.hi <= {lo}", f"x.lo >= {hi}"))
        steps.append(f"CASE WHEN n > {span * fanout ** (j - 1)} THEN struct({left} AS left, {right} AS right) END")
    return f"filter(array({', '.join(steps)}), s -> s IS NOT NULL)"


def climb(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The tiers of all trees over ``leaves`` (tree, n, lo, digest, load), each a written table of runs.

    A run has the bucket's ``items`` (lo, hi, digest, load) and its top node.  The last
    tier has one run per tree, whose top covers the whole tree.
    """
    units = leaves.withColumn("hi", F.col("lo") + 1)
    largest = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    tiers, span = [], 1
    while True:
        width = span * fanout ** BAND
        runs = (units.withColumn("bucket", F.expr(f"lo div {width}")).groupBy("tree", "n", "bucket")
                .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", "load"))).alias("items"))
                .withColumn("first", F.col("bucket") * width))
        tiers.append(written(with_levels(runs, span, fanout).selectExpr("tree", "n", "bucket", "first", "items", f"get(_l{BAND}, 0) AS top"), "merkle-tier"))
        span = width
        if span >= largest:
            return tiers
        units = tiers[-1].select("tree", "n", "top.lo", "top.hi", "top.digest", F.lit(None).cast("string").alias("load"))


def tops(tiers: list[DataFrame]) -> DataFrame:
    """(tree, n, lo, hi, digest) of the top node of each tree."""
    return tiers[-1].select("tree", "n", "top.lo", "top.hi", "top.digest")


def nodes(tiers: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """The manifest: (tree, level, lo, hi, digest) of every node of every tree."""
    out, span = None, 1
    for t, runs in enumerate(tiers):
        levels = [f"CASE WHEN n > {span * fanout ** (j - 1) if j else 0} THEN transform(_l{j}, x -> struct({t * BAND + j} AS level, x.lo, x.hi, x.digest)) END"
                  for j in range(0 if t == 0 else 1, BAND + 1)]
        part = with_levels(runs, span, fanout).selectExpr(
            "tree", f"inline(flatten(filter(array({', '.join(levels)}), a -> a IS NOT NULL))) AS (level, lo, hi, digest)")
        out, span = part if out is None else out.unionByName(part), span * fanout ** BAND
    return out


def descend(tiers: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """(tree, lo, digest, load, path, facts) of every leaf.

    ``above`` (tree, lo, hi, path, facts) says for the top of each tree which siblings come after
    its own levels.  Each tier's runs find the unit above by bucket and containment.
    """
    for t in range(len(tiers) - 1, -1, -1):
        span = fanout ** (t * BAND)
        width = span * fanout ** BAND
        up = above.selectExpr("tree AS _tree", f"lo div {width} AS _bucket", "lo AS _lo", "hi AS _hi", "path AS _path", "facts")
        held = tiers[t].join(up, F.expr("tree = _tree AND bucket = _bucket AND _lo <= top.lo AND top.hi <= _hi"))
        path = f"concat({_path_in_run('u.lo', 'u.hi', span, fanout)}, _path)"
        above = with_levels(held, span, fanout).selectExpr(
            "tree", "facts", f"inline(transform(items, u -> struct(u.lo, u.hi, u.digest, u.load, {path}))) AS (lo, hi, digest, load, path)")
    return above


def proofs(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, lo, digest, load, path, facts): every leaf's siblings up to the root.

    ``leaves`` holds ``tree`` (see ``tree_key``), ``id``, ``digest`` and ``load`` (anything to
    carry along); ``facts`` has the ``root`` and the tree's ``subroot``.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of at least 2")
    table = written(leaves.select("tree", "id", "digest", "load"), "merkle-leaves")
    tiers = climb(ranked(table, ["id", "digest"]), fanout)
    groups = written(tops(tiers).select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.struct("tree", "n").alias("load")), "merkle-subroots")
    upper = climb(ranked(groups, ["id"]), fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = tops(upper).select("tree", "lo", "hi", none.alias("path"), F.struct(F.col("digest").alias("root")).alias("facts"))
    above = descend(upper, root, fanout).select(
        F.col("load.tree").alias("tree"), F.lit(0).cast("bigint").alias("lo"), F.col("load.n").alias("hi"), "path",
        F.struct(F.col("facts.root").alias("root"), F.col("digest").alias("subroot")).alias("facts"))
    return descend(tiers, above, fanout)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def oracle_sql() -> str:
    """DuckDB SQL for ``op13_merkle_manifest`` (unique ids)."""
    fields = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
                         for c in ("doc_id", "source", "lang", "{n}", "text"))
    return f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, sha256({fields.replace('{n}', 'n_chars')}) AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN sha256({fields.replace('{n}', '(n_chars + 1)')}) END AS tampered,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM documents),
lang_nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaf UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM lang_nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM lang_nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, pos, n, digest FROM subroots UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top_nodes WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.doc_id, s.level AS k, s.digest, s.pos % 2 = 0 AS is_left FROM leaf l JOIN lang_nodes s ON s.tree = l.tree AND s.pos = xor(l.pos >> s.level, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + s.level, s.digest, s.pos % 2 = 0 FROM leaf l JOIN subroots r ON r.tree = l.tree JOIN top_nodes s ON s.pos = xor(r.pos >> s.level, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth FROM steps),
full_steps AS (
  SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.k) AS nth, s.digest, s.is_left FROM (
    SELECT l.doc_id, x.level AS k FROM leaf l JOIN (SELECT DISTINCT tree, level FROM lang_nodes WHERE n > 1) x ON x.tree = l.tree
    UNION ALL SELECT l.doc_id, 1000 + x.level FROM leaf l CROSS JOIN (SELECT DISTINCT level FROM top_nodes WHERE n > 1) x) h
  LEFT JOIN numbered s ON s.doc_id = h.doc_id AND s.k = h.k),
fold AS (
  SELECT doc_id, 0 AS nth, coalesce(tampered, leaf) AS acc FROM leaf UNION ALL
  SELECT f.doc_id, s.nth, CASE WHEN s.digest IS NULL THEN sha256(f.acc) WHEN s.is_left THEN sha256(s.digest || f.acc) ELSE sha256(f.acc || s.digest) END
  FROM fold f JOIN full_steps s ON s.doc_id = f.doc_id AND s.nth = f.nth + 1),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(digest, '' ORDER BY nth), '')) AS proof_sha256, max(nth) AS last FROM full_steps GROUP BY doc_id)
SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.acc AS folded_root, f.acc = t.digest AS verified
FROM leaf l JOIN subroots r ON r.tree = l.tree CROSS JOIN (SELECT digest FROM top_nodes WHERE n = 1) t
LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN fold f ON f.doc_id = l.doc_id AND f.nth = coalesce(p.last, 0)"""
