"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut into two halves; each half is quantised with its own codebook, and a vector
lies in the cell of its two codes.  A query adds up its inner products with the two codes
of a cell (the summed distance, negated) and walks the code pairs from the best down with a
heap, until the cells visited hold a given share of the index (and k + 2 entries); the entries of these cells
are reranked by exact inner products in double precision.

Equal vectors form one class, which is searched once and holds its smallest ids only: of
equal scores the smaller ids win, so larger ones can be in no result.  A block of cells is
cut into parts of bounded size, and so are the queries of a block, so no group is
unbounded.  The codebooks are fitted on ``fit_rows`` classes chosen by a hash (a documented
bound); every row is indexed.

Edge cases: vectors that are NULL, empty, zero, or hold NULL or non-finite numbers take no
part, nor do rows without an id or of another length than most; rows of one id and one
vector are one row; a query's own id is never among its neighbours; fewer than ``k`` others: all
of them; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import join_hot_safe, written

CODES, SHARE, FIT_ROWS = 64, 0.55, 10_000
BLOCKS, BLOCK_ROWS, BLOCK_QUERIES = 16, 8192, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids; starts from evenly spaced rows of ``x``."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def visit(left: np.ndarray, right: np.ndarray, population: np.ndarray, wanted: float) -> list[int]:
    """Cells (left code * codes + right code) by falling summed score until they hold ``wanted`` entries.

    The heap holds, for each left code begun, its next right code in order.
    """
    k = len(right)
    lo, ro = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    ls, rs = left[lo].tolist(), right[ro].tolist()
    cell = (lo[:, None] * k + ro).tolist()
    heap, out, held = [(-ls[0] - rs[0], 0, 0)], [], 0
    while heap:
        _, i, j = heapq.heappop(heap)
        c = cell[i][j]
        if population[c]:
            out.append(c)
            held += population[c]
            if held >= wanted:
                break
        if j == 0 and i + 1 < len(ls):
            heapq.heappush(heap, (-ls[i + 1] - rs[0], i + 1, 0))
        if j + 1 < k:
            heapq.heappush(heap, (-ls[i] - rs[j + 1], i, j + 1))
    return out


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f8").reshape(-1, dim)


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
           codes: int = CODES, share: float = SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best entries found for each row of ``is_query``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          is_query.alias("q")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, half = size.d, size.d // 2
    rows = rows.where(F.size("v") == dim).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    # classes of equal vectors with their k + 1 smallest ids: first per range of ids, then over ranges
    keys = ["h1", "h2"]
    per_range = rows.groupBy(*keys, F.shiftright("id", 10).alias("r")).agg(
        F.first("v").alias("v"), F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    wider = per_range.groupBy(*keys, F.shiftright("r", 10).alias("r")).agg(
        F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    classes = wider.groupBy(*keys).agg(
        F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    classes = written(classes.withColumn("c", F.col("ids")[0]), "ann-classes")
    total = classes.count()
    sample = (classes.orderBy(F.xxhash64("c"), "c").limit(fit_rows).select("v").toPandas())["v"]
    fit = np.array(sample.tolist())
    n_codes = min(codes, len(fit))
    books = [kmeans(fit[:, :half], n_codes), kmeans(fit[:, half:], n_codes)]
    per_block = -(-n_codes // BLOCKS)        # left codes of a block

    def assign(parts):
        for pdf in parts:
            x = np.array(pdf["v"].tolist()).reshape(-1, dim)
            cell = nearest(x[:, :half], books[0]) * n_codes + nearest(x[:, half:], books[1])
            yield pd.DataFrame({"c": pdf["c"], "cell": cell, "ids": pdf["ids"], "vec": [r.astype("<f8").tobytes() for r in x]})
    index = written(classes.select("c", "v", "ids").mapInPandas(assign, "c long, cell long, ids array<long>, vec binary"), "ann-index")
    population = np.zeros(n_codes * n_codes, np.int64)
    for r in index.groupBy("cell").count().collect():       # at most codes * codes rows
        population[r.cell] = r["count"]

    asked = rows.where("q").select("id", *keys).join(classes.select(*keys, "c"), keys).select("id", "c").distinct()
    weights = asked.groupBy("c").agg(F.count(F.lit(1)).alias("w"))
    queries = index.join(weights.select("c"), "c", "left_semi").select("c", "vec")
    counted = weights.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("t")).first()
    span = per_block * n_codes
    block_rows = np.add.reduceat(population, np.arange(0, len(population), span))
    row_parts = [int(x) for x in -(-block_rows // BLOCK_ROWS)]
    query_parts = max(1, -(-counted.n // BLOCK_QUERIES))

    def route(parts):
        """Each query with, per block, a bit for every cell that it visits."""
        for pdf in parts:
            x = _matrix(pdf["vec"], dim)
            left, right = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
            out = []
            for c, vec, a, b in zip(pdf["c"], pdf["vec"], left, right, strict=True):
                bits = np.zeros(len(block_rows) * span, bool)
                bits[visit(a, b, population, max(share * total, k + 2))] = True
                for blk, part in enumerate(bits.reshape(-1, span)):
                    if part.any():
                        packed = np.packbits(part).tobytes()
                        out.extend((blk, s, (int(c) * 2654435761 >> 8) % query_parts, c, vec, packed) for s in range(row_parts[blk]))
            yield pd.DataFrame(out, columns=["block", "rp", "qp", "c", "vec", "cells"])
    visits = queries.mapInPandas(route, "block int, rp int, qp int, c long, vec binary, cells binary")
    parts_of = F.array(*[F.lit(max(1, x)) for x in row_parts])
    block = (F.col("cell") / span).cast("int")
    entries = (index.withColumn("block", block)
               .withColumn("rp", F.pmod(F.xxhash64("c"), parts_of[F.col("block")]).cast("int"))
               .withColumn("qp", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))))

    def rerank(ent: pd.DataFrame, que: pd.DataFrame) -> pd.DataFrame:
        if not len(ent) or not len(que):
            return pd.DataFrame({"c": [], "best": []})
        v, first = _matrix(ent["vec"], dim), int(ent["block"].iloc[0]) * span
        cell = ent["cell"].to_numpy() - first
        ids = ent["ids"].tolist()
        own = ent["c"].to_numpy()
        out = []
        for lo in range(0, len(que), 256):
            part = que.iloc[lo:lo + 256]
            bits = np.unpackbits(np.frombuffer(b"".join(part["cells"]), np.uint8).reshape(len(part), -1), axis=1).astype(bool)
            score = np.where(bits[:, cell], _matrix(part["vec"], dim) @ v.T, -np.inf)
            for c, s in zip(part["c"], score, strict=True):
                seen = np.flatnonzero(s > -np.inf)
                if len(seen) > k + 1:      # the k+1 best classes, ties to the class with the smaller id
                    bar = np.partition(s[seen], len(seen) - k - 1)[len(seen) - k - 1]
                    seen = seen[s[seen] >= bar]
                    seen = seen[np.lexsort((own[seen], -s[seen]))][:k + 1]
                best = sorted((-s[i], m) for i in seen for m in ids[i])[:k + 1]
                out.append((c, [{"score": -a, "id": m} for a, m in best]))
        return pd.DataFrame(out, columns=["c", "best"])
    group = ["block", "rp", "qp"]
    ranked = (entries.groupBy(*group).cogroup(visits.groupBy(*group))
              .applyInPandas(rerank, "c long, best array<struct<score:double,id:long>>"))
    order = "array_sort(flatten(collect_list(best)), (a, b) -> CASE WHEN a.score > b.score THEN -1 WHEN a.score < b.score THEN 1 " \
            "WHEN a.id < b.id THEN -1 WHEN a.id > b.id THEN 1 ELSE 0 END)"
    best = ranked.groupBy("c").agg(F.slice(F.expr(order), 1, k + 1).alias("best")).join(weights, "c")
    both = join_hot_safe(asked, best, ["c"], "w", int(counted.t or 0))
    return both.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.expr("filter(best, x -> x.id <> id)"), 1, k)).alias("p", "n")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score"))
