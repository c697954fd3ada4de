"""Vector bin packing of token sequences under several limits at once.

A sequence may hold at most ``max_tokens`` tokens, ``max_segments`` pieces and ``max_loss``
loss-bearing tokens.  The dot-product heuristic fills one sequence at a time: of the pieces
that fit, it takes the one whose demand vector has the largest dot product with the room
that is left (each dimension weighted by how scarce it is in the group at hand).  When
nothing fits and at least ``min_cut`` tokens of room are left, the best piece is cut.

Spark deals documents out as they lie in the input; a task packs groups of at most
``group`` pieces (or ``group_tokens`` tokens) and carries the unfinished sequence's pieces
over to its next group, so no shuffle is needed, no key gathers and memory is bounded.
A sequence that closes with room left (at the end of a task, or because the segments or the
loss-bearing tokens are used up) is cut into sequences whose lengths are powers of two, which need
no padding.

A task holds one slice of text, a group's ids (``group_tokens`` of 4 bytes, or one document)
and its pieces.

Edge cases: a NULL or empty text is a document of the end id alone; repeated rows are packed
as separate documents; a text longer than a sequence is cut; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.chunks import token_table
from curatio.llm.common import text_slices, tokenizer_file

PIECES = ("doc_id long, start long, length long, loss_tokens long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 4096
    max_segments: int = 64
    max_loss: int = 4096
    min_cut: int = 16
    group: int = 4096
    group_tokens: int = 4_000_000

    def __post_init__(self) -> None:
        for name in ("max_tokens", "max_segments", "max_loss", "min_cut", "group", "group_tokens"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


#: For instruction data: at most half of a sequence bears loss, so that the limit binds beside the tokens.
INSTRUCTION = Limits(max_loss=2048)


def loss_of(start: int, length: int, prompt: int) -> int:
    """Loss-bearing tokens of the piece: those after the document's first ``prompt`` tokens."""
    return max(0, start + length - max(start, prompt))


def fitting(start: int, tokens: int, loss: int, prompt: int) -> int:
    """The longest piece from ``start`` with at most that many tokens and loss-bearing tokens."""
    return min(tokens, max(0, prompt - start) + loss)


def pack_group(pieces: list[tuple[int, int, int, int]], lim: Limits, last: bool = True
               ) -> tuple[list[list[tuple[int, int, int, int]]], list[tuple[int, int, int, int]]]:
    """Sequences of pieces (key, start, length, prompt) and, unless ``last``, the pieces left over."""
    n = len(pieces)
    cap = 2 * n + 8 * (sum(p[2] for p in pieces) // lim.max_tokens + 2)
    dem = np.zeros((cap, 3))
    alive: list = list(pieces)
    caps = np.array([lim.max_tokens, lim.max_segments, lim.max_loss], float)
    for i, (_, s, ln, p) in enumerate(pieces):
        dem[i] = ln, 1, loss_of(s, ln, p)
    weight = dem[:n].sum(axis=0) / caps / caps**2 if n else caps * 0
    out: list = []
    while n:
        if not last and dem[:n, 0].sum() < lim.max_tokens:
            break
        room, seq = caps.copy(), []
        while n and room[1] >= 1 and room[0] >= 1:
            d = dem[:n]
            score = d @ (weight * room)
            score[(d > room).any(axis=1)] = -1.0
            i = int(score.argmax())
            key, s, ln, p = alive[i]
            if score[i] < 0:
                if room[0] < lim.min_cut:
                    break
                part = [min(fitting(x[1], int(room[0]), int(room[2]), x[3]), x[2]) for x in (alive[j] for j in range(n))]
                i = int(np.argmax(part))
                key, s, ln, p = alive[i]
                if part[i] < min(lim.min_cut, ln):
                    break
                cut = part[i]
                seq.append((key, s, cut, p))
                room -= (cut, 1, loss_of(s, cut, p))
                alive[i] = (key, s + cut, ln - cut, p)
                dem[i] = ln - cut, 1, loss_of(s + cut, ln - cut, p)
                continue
            seq.append(alive[i])
            room -= dem[i]
            n -= 1
            alive[i] = alive[n]
            dem[i] = dem[n]
            alive.pop()
        out.append(seq)
    return out, alive[:n]


def powers_of_two(seq: list[tuple[int, int, int, int]], lim: Limits) -> list[list[tuple[int, int, int, int]]]:
    """A sequence with room left, cut into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in seq)
    if total >= lim.max_tokens - lim.min_cut or total == 0:
        return [seq]
    out, todo = [], list(seq)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part = []
        while size:
            key, s, ln, p = todo.pop(0)
            take = min(ln, size)
            part.append((key, s, take, p))
            if take < ln:
                todo.insert(0, (key, s + take, ln - take, p))
            size -= take
        out.append(part)
    return out


def pack_documents(docs: DataFrame, end_id: int = 2, limits: Limits | None = None, tokenizer_path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """Pieces of every document with their place: columns of ``PIECES``; ids little-endian u32.

    With ``prompt_col`` (instruction data) a document is prompt, text, end id and only the
    tokens after the prompt bear loss; else all do.
    """
    lim, path = limits or Limits(), tokenizer_path or tokenizer_file()
    cols = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
            (F.col(prompt_col).cast("string") if prompt_col else F.lit("")).alias("prompt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = token_table(path), TaskContext.get().partitionId()
        held: dict[int, tuple] = {}     # key -> (doc_id, ids)
        pool: list = []
        state = {"key": 0, "seq": task << 40}

        def emit(seqs: list) -> pa.RecordBatch:
            rows = []
            for seq in seqs:
                offset = 0
                for key, s, ln, p in seq:
                    doc, ids = held[key]
                    rows.append((doc, s, ln, loss_of(s, ln, p), len(ids), state["seq"], offset, ids[s:s + ln].tobytes()))
                    offset += ln
                state["seq"] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def unpadded(seqs: list) -> list:
            return [x for seq in seqs for x in powers_of_two(seq, lim)]

        full: list = []
        tokens = 0
        for part, texts in text_slices(batches):
            prompts = part.column(2).to_pylist()
            flat, counts = table.rows(texts)
            pre, pre_counts = table.rows(prompts)
            ends, pre_ends = np.cumsum(counts), np.cumsum(pre_counts)
            for doc, n, e, pn, pe in zip(part.column(0).to_pylist(), counts.tolist(), ends.tolist(),
                                         pre_counts.tolist(), pre_ends.tolist(), strict=True):
                ids = np.empty(pn + n + 1, "<u4")
                ids[:pn], ids[pn:-1], ids[-1] = pre[pe - pn:pe], flat[e - n:e], end_id
                key = state["key"]
                state["key"] += 1
                held[key] = (doc, ids)
                s = 0
                while True:   # whole sequences first; the rest goes to the packer
                    ln = min(len(ids) - s, fitting(s, lim.max_tokens, lim.max_loss, pn))
                    if ln == lim.max_tokens:
                        full.append([(key, s, ln, pn)])
                    elif ln:
                        pool.append((key, s, ln, pn))
                    s += ln
                    if s >= len(ids):
                        break
                tokens += len(ids)
                if len(pool) >= lim.group or tokens >= lim.group_tokens:
                    seqs, pool = pack_group(pool, lim, last=False)
                    yield emit(full + unpadded(seqs))
                    held = {k[0]: held[k[0]] for k in pool}
                    full, tokens = [], sum(len(v[1]) for v in held.values())
                    if tokens >= lim.group_tokens // 2:      # long documents of which a piece is left
                        seqs, pool = pack_group(pool, lim)
                        yield emit(unpadded(seqs))
                        held, tokens = {}, 0
        seqs, _ = pack_group(pool, lim)
        yield emit(full + unpadded(seqs))
    return docs.select(*cols).mapInArrow(run, PIECES)
