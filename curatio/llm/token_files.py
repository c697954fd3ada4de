"""Token ids as files: frequency ranks in byte-aligned variable-length coding.

Every id is replaced by its rank in the corpus (0 = most frequent), so that most numbers
fit one byte.  A number takes 1 to 4 bytes; the byte counts are kept apart from the data,
two bits each, four in a control byte.  Decoding looks each control byte up in a table
of four lengths and scatters the data bytes, all in numpy.

File layout (a Parquet table in ascending id order, one row per block):
``shard`` (file), ``block`` (number in the shard), ``start`` (ids of the shard before the
block), ``n_tokens``, ``doc_ids``, ``counts`` (ids of each document), ``control``,
``data``.  Beside it ``ranks``: (id, rank).

Edge cases: a NULL or empty text is a document holding only the end id; a NULL doc_id sorts
first; equal doc_ids are ordered by their ids, repeated rows stay separate; an empty table
gives files without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatio.llm.chunks import token_table
from curatio.llm.common import id_and_text, text_slices, tokenizer_file, written

BLOCK_TOKENS = 1 << 20
_BLOCKS = ("shard int, block long, start long, n_tokens long, doc_ids array<long>, counts array<long>, "
           "control binary, data binary")
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(values, np.uint32)
    code = (v > 0xFF).astype(np.uint8)
    for bar in (0xFFFF, 0xFFFFFF):
        if len(v) and v.max() > bar:
            code += v > bar
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[:len(v)] = code
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    first = np.cumsum(code, dtype=np.int64) - code + np.arange(len(v))      # place of each number's lowest byte
    data = np.empty(len(v) + int(code.sum(dtype=np.int64)), np.uint8)
    data[first] = v.astype(np.uint8)
    for b in range(1, int(code.max()) + 1 if len(v) else 1):
        at = np.flatnonzero(code >= b)
        data[first[at] + b] = (v[at] >> np.uint32(8 * b)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``encode_numbers``, by table lookup."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    out = raw[first].astype(np.uint32)
    for b in range(1, int(lengths.max()) if n else 1):
        at = np.flatnonzero(lengths > b)
        out[at] |= raw[first[at] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def tokenize(docs: DataFrame, end_id: int, tokenizer_path: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, width, ids): ids of each whole text and then ``end_id``.

    ``ids`` is binary, little-endian unsigned numbers of ``width`` bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(tokenizer_path)
        width = table.dtype.itemsize if end_id < 1 << 16 else 4
        for part, texts in text_slices(batches):
            flat, counts = table.rows(texts)
            n = counts + 1
            ids = np.full(len(flat) + len(n), end_id, f"<u{width}")
            text = np.ones(len(ids), bool)
            text[np.cumsum(n) - 1] = False
            ids[text] = flat
            offsets = np.concatenate([[0], np.cumsum(n)]) * width
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(np.full(len(n), width, np.int32)), raw],
                ["doc_id", "n_tokens", "width", "ids"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids of each row) of a batch of ``tokenize``."""
    col = batch.column("ids")
    n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
    width = batch.column("width")[0].as_py()
    bounds = np.frombuffer(col.buffers()[1], "<i4")[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[bounds[0]:bounds[-1]].view(f"<u{width}"), n


def token_counts(encoded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in the whole corpus; each task sends one row per id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                part = np.bincount(_numbers(batch)[0], minlength=len(total))
                part[:len(total)] += total
                total = part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])
    return (encoded.select("n_tokens", "width", "ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def rank_ids(counts: DataFrame) -> np.ndarray:
    """Ids by rank: most frequent first, ties to the smaller id.

    Comes to the driver: at most one row per entry of the tokenizer's vocabulary.
    """
    got = counts.toPandas()
    n, ids = got["n"].to_numpy(np.int64), got["id"].to_numpy(np.int64)
    return ids[np.lexsort((ids, -n))]


def write_sequences(encoded: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``tokenize``'s rows as the files described above, in ascending doc_id order."""
    spark = encoded.sparkSession
    by_rank = rank_ids(token_counts(encoded))
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # one number per vocabulary entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, shard = shared.value, TaskContext.get().partitionId()
        docs: list = []
        counts: list = []
        parts: list = []
        block = start = held = 0

        def flush() -> pa.RecordBatch:
            control, data = encode_numbers(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (shard, pa.int32()), (block, pa.int64()), (start, pa.int64()), (held, pa.int64()),
                    (docs, pa.list_(pa.int64())), (counts, pa.list_(pa.int64())),
                    (control, pa.binary()), (data, pa.binary()))],
                ["shard", "block", "start", "n_tokens", "doc_ids", "counts", "control", "data"])
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, n = _numbers(batch)
            coded, ends = ranks[flat], np.cumsum(n)
            for doc, size, end in zip(batch.column("doc_id").to_pylist(), n.tolist(), ends.tolist(), strict=True):
                if held and held + size > block_tokens:
                    yield flush()
                    block, start, held, docs, counts, parts = block + 1, start + held, 0, [], [], []
                docs.append(doc)
                counts.append(size)
                parts.append(coded[end - size:end])
                held += size
        if held:
            yield flush()
    (encoded.repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "ids")
     .mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks"))
    spark.createDataFrame([(int(i), r) for r, i in enumerate(by_rank)], "id long, rank long") \
        .coalesce(1).write.parquet(f"{path}/ranks")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids are little-endian unsigned 32-bit."""
    by_rank = rank_ids(spark.read.parquet(f"{path}/ranks").select("id", (-F.col("rank")).alias("n")))
    shared = spark.sparkContext.broadcast(by_rank.astype(np.uint32))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, total = (batch.column(c)[row].as_py() for c in ("shard", "start", "n_tokens"))
                n = np.asarray(batch.column("counts")[row].values, np.int64)
                docs = batch.column("doc_ids")[row].values
                ranks = decode_numbers(batch.column("control")[row].as_py(), batch.column("data")[row].as_py(), total)
                ids = ids_of[ranks].astype("<u4")
                ends = np.cumsum(n)
                offsets = np.concatenate([[0], ends * 4]).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), docs, pa.array(start + ends - n), pa.array(n),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])],
                    ["shard", "doc_id", "local", "n_tokens", "ids"])
    docs = blocks.select("shard", "start", "n_tokens", "doc_ids", "counts", "control", "data").mapInArrow(
        run, "shard int, doc_id long, local long, n_tokens long, ids binary")
    # ids of earlier shards: one row per written file, so a small table
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, tokenizer_path: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise whole texts and write them; each text is tokenised once, into a scratch table."""
    write_sequences(written(tokenize(docs, end_id, tokenizer_path or tokenizer_file(), id_col, text_col), "tokens"), path)
