"""Small helpers shared by the operators: column choice, scratch tables, hot keys, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from curatio.session import ensure_checkpoint_dir, scratch_path

DEFAULT_TOKENIZER = "word_bpe_49k.json"
SLICE_CHARS = 500_000
HOT_ROWS = 20_000       # rows of one key that a join may bring into one task
ROWS_A_TASK = 50_000    # links that one task of a components pass writes


def tokenizer_file(name: str = DEFAULT_TOKENIZER) -> str:
    """Place of a public tokenizer's vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the key and the text, so that other columns (of whatever name) never travel."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose crc32(id as text) mod 4 is 2; a NULL id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def written(df: DataFrame, name: str, codec: str = "zstd", fmt_options: dict | None = None) -> DataFrame:
    """``df`` written as a Parquet table below the shared checkpoint folder, and read back.

    This cuts the lineage: a lost executor re-reads the files instead of re-running the job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).options(**(fmt_options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Arrow batches cut so that each slice holds at most ``limit`` bytes of text, or one row.

    Bounds the Python memory of a task whatever the row count of an Arrow batch; the last
    column of name ``text`` is converted, slice by slice.
    """
    import pyarrow.compute as pc
    batch = part = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                part = batch.slice(start, i - start)
                yield part, part.column(k).to_pylist()
                start, total = i, 0
            total += n
        part = batch.slice(start)
        yield part, part.column(k).to_pylist()
    del batch, part
    pa.default_memory_pool().release_unused()       # Spark keeps the worker for later stages


def join_hot_safe(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str,
                  total: int, parts: int = 2000, how: str = "inner", floor: int = HOT_ROWS, largest: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` (one fact row per key) when one key may hold a third of ``rows``.

    ``weight`` (in ``facts``, a written table or cheap to compute) is how many rows have the key.
    A key is hot with more than ``total / parts`` rows, and more than ``floor``, which one task
    takes in its stride.  Hot keys number fewer than ``parts``, so that side is broadcast with a
    proven bound; the rest has no hot key and is joined by an ordinary shuffle.  Where no
    key is hot (``largest``, or the facts are asked), the ordinary join is the whole plan:
    every join planned costs the driver memory that it doesn't give back.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    keys = list(keys)
    bar = max(floor, 1 << max(0, (total // parts).bit_length()))    # a power of two, so that passes share compiled code
    names = [c for c in facts.columns if c not in keys]
    if largest is None:
        largest = facts.agg(F.max(weight)).first()[0] or 0
    if largest <= bar:
        return rows.join(facts, keys, how).select(*rows.columns, *names)
    hot = facts.where(F.col(weight) > bar).withColumn("_hot", F.lit(True))
    cool = facts.where(F.col(weight) <= bar)
    marked = rows.join(F.broadcast(hot.select(*keys, "_hot", *[F.col(c).alias(f"_h_{c}") for c in names])), keys, "left")
    first = marked.where(F.col("_hot")).select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in names])
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns)
    return first.unionByName(rest.join(cool, keys, how).select(*rows.columns, *names))


def _pass(df: DataFrame, name: str, rows: int, *seen: Column) -> tuple[DataFrame, dict]:
    """``df`` written by a number of tasks that fits ``rows`` narrow rows, and what was ``seen`` of it meanwhile."""
    noted = Observation()
    out = written(df.coalesce(max(8, rows // ROWS_A_TASK)).observe(noted, F.count(F.lit(1)).alias("n"), *seen), name)
    return out, noted.get


def components(links: DataFrame, a: str = "a", b: str = "b", floor: int = HOT_ROWS) -> DataFrame:
    """Connected components of an undirected link table: (node, root), root = smallest node.

    Alternating large-star and small-star passes (each a groupBy of the links by node).  A
    node's neighbours are never gathered: only their minimum is, by a partial aggregate, and
    a hub's links get it by a broadcast of hubs of bounded number.  Every step writes its
    table, by as many tasks as its rows need, so that all passes plan the same few small
    queries; the loop ends when a pass changes no link.
    """
    e, seen = _pass(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star-links", links.count())
    low_of, most = F.expr("min(v)").alias("m"), F.coalesce(F.max("c"), F.lit(0)).alias("most")
    print_of, digest = F.expr("coalesce(sum(cast(xxhash64(u, v) AS decimal(38, 0))), 0)").alias("print"), None
    while seen["n"]:
        n = 2 * seen["n"]
        # large-star: every larger neighbour of x is linked to the smallest node around x
        both = e.selectExpr("inline(array(struct(u, v), struct(v AS u, u AS v)))")
        low, noted = _pass(both.groupBy("u").agg(low_of, F.count(F.lit(1)).alias("c")).selectExpr("u", "least(u, m) AS m", "c"), "star-low", n, most)
        large = join_hot_safe(both, low, ["u"], "c", n, floor=floor, largest=noted["most"]).where("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        large, _ = _pass(large, "star-large", n)
        # small-star: every smaller neighbour of x, and x, is linked to the smallest of them
        low, noted = _pass(large.groupBy("u").agg(low_of, F.count(F.lit(1)).alias("c")), "star-low", n, most)
        small = join_hot_safe(large, low, ["u"], "c", n, floor=floor, largest=noted["most"])
        e, seen = _pass(small.selectExpr("inline(array(struct(v AS u, m AS v), struct(u, m AS v)))").where("u <> v").distinct(), "star-links", n, print_of)
        if seen == digest:
            break
        digest = seen
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text (it has no such function): one byte, then one bit at a time."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
            f"lambda c, b: {byte}), 4294967295)")
