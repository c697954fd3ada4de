"""Values of whitespace-separated chunks, remembered per Python worker.

Texts repeat most of their words.  A :class:`ChunkTable` computes the values of each
distinct chunk once (by the function it is given) and then maps whole batches of texts to
their values in numpy: chunk borders and 64-bit chunk hashes from the bytes, a hash-table
lookup, and gathers.  It is an in-task memo of bounded size: when it is full, the chunks seen
least go, which changes no result.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

_R = np.random.default_rng(64)
_BYTE = _R.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _LENGTH = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _gather(start: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions ``start[i] .. start[i] + size[i] - 1`` of all runs end to end; ``ends = cumsum(size)``."""
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


def ragged(lists: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers end to end, how many belong to each list)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype, int(sizes.sum())), sizes


class _Powers:
    """Powers of the hash's base and of its inverse, modulo 2**64, as far as needed yet."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def split_and_hash(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the chunks of ``raw``, its parts between ASCII blanks.

    The hash is a polynomial over random byte values; prefix sums give it for all chunks at
    once.  Two of a million chunks share one with a probability of about 1e-7.
    """
    text = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[text], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.get(len(text) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * up[:-1])])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH
    h ^= h >> np.uint64(32)
    h *= np.uint64(_BASE)
    h ^= h >> np.uint64(29)
    return start, end, np.where(h == 0, np.uint64(1), h)


class ChunkTable:
    """``values_of(list of chunks)`` gives ``ragged`` numbers: all end to end, and each chunk's count."""

    def __init__(self, values_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 400_000) -> None:
        self.values_of, self.dtype, self.limit = values_of, np.dtype(dtype), limit
        self.bits = max(10, (4 * limit - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)       # open addressing; 0 is free
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.hash = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, self.dtype)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            k = self.keys[at]
            same = k == h[todo]
            out[todo[same]] = self.slot[at[same]]
            go = ~same & (k != 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, h: np.ndarray, slots: np.ndarray) -> None:
        """Puts distinct new hashes into the table."""
        todo, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[todo[free]]              # of several for one place, one stays
            won = free[self.keys[at[free]] == h[todo[free]]]
            self.slot[at[won]] = slots[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _shrink(self) -> None:
        """Keeps the chunks seen most often, at most half of the limit."""
        least = 2
        while np.count_nonzero(self.hits[:self.n] >= least) > self.limit // 2:
            least *= 2
        keep = np.flatnonzero(self.hits[:self.n] >= least)
        size = self.size[keep]
        ends = np.cumsum(size)
        flat = self.flat[_gather(self.start[keep], size, ends)]
        self.n, self.used = len(keep), len(flat)
        self.flat[:self.used], self.hash[:self.n] = flat, self.hash[keep]
        self.size[:self.n], self.start[:self.n] = size, ends - size
        self.hits[:] = 0
        self.keys[:] = 0
        self._insert(self.hash[:self.n], np.arange(self.n))

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Adds the chunks ``raw[start:end]``, whose hashes are distinct and new."""
        words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        vals, sizes = self.values_of(words)
        first, total = self.n, len(vals)
        self.n += len(words)
        while self.n > len(self.start):
            self.start, self.size, self.hits, self.hash = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits, self.hash))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[first:self.n] = self.used + np.cumsum(sizes) - sizes
        self.size[first:self.n], self.hash[first:self.n] = sizes, h
        self.flat[self.used:self.used + total] = vals
        self.used += total
        while 2 * self.n > 1 << self.bits:          # a batch of more distinct chunks than the limit
            self.bits += 1
            self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            first, h = 0, self.hash[:self.n]
        self._insert(h, np.arange(first, self.n))

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slot of every chunk, chunks of each text)."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        raw = b"\n".join(parts)
        start, end, h = split_and_hash(raw)
        if self.n > self.limit:
            self._shrink()
        slots = self._find(h)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            self._learn(raw, start[new[first]], end[new[first]], fresh)
            slots[new] = self._find(h[new])
        self.hits[:self.n] += np.bincount(slots, minlength=self.n)
        return slots, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' values end to end, and how many belong to each text (NULL: none)."""
        gc.disable()        # the many short strings hold no cycles; scanning them takes long
        try:
            slots, counts = self._slots([t or "" for t in texts])
        finally:
            gc.enable()
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        at = _gather(self.start[slots], sizes, ends)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], np.diff(bounds)


_TABLES: dict = {}


def shared_table(key, make: Callable[[], object]):
    """The worker's table under ``key``; Spark reuses Python workers, so later tasks find it filled.

    Only the table in use is kept: that of an earlier operator would take memory to the end.
    """
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


# Letters (lower case, precomposed), digits and ASCII symbols: text for which lower-casing and
# splitting as below is what the tokenizer's own normaliser and pattern do.  The pattern
# must equal that of the vocabulary file, restricted to these characters; a line end stands
# between chunks.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_OTHER = re.compile("[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_PIECE = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class _Pieces(dict):
    """Piece -> ids, by the tokenizer's model; emptied when it is full."""

    def __init__(self, tok, limit: int = 100_000) -> None:
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.model, self.limit = tok.model, limit
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = self[piece] = tuple([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.bytes_of))]) if piece != "\n" else ()
        return got

    def of_chunks(self, chunks: list[str], dtype) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= self.limit:
            self.clear()
        parts = _PIECE.findall("\n".join(chunks).lower())
        flat, sizes = ragged([self[p] for p in parts], dtype)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.flatnonzero(np.fromiter((p == "\n" for p in parts), bool, len(parts)))
        return flat, np.diff(ends[np.concatenate([[0], marks, [len(parts)]])])


def token_table(path: str) -> ChunkTable:
    """Chunk -> token ids.  Exact for tokenizers that drop white space and never join across it:
    checked once per worker on a text with mixed spacing.

    Where the file is a byte-level BPE whose pattern is ``_PIECE``'s, plain chunks are cut
    into pieces that share one memo; other chunks go through the tokenizer as they are.
    """
    def make() -> ChunkTable:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # one core per task
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        probe = "Ab, c'd\n\u00e9t\u00e9  12 <x>\tend. I'LL ''s \u00c0\u00df\u00d7 a--b"
        whole = tok.encode(probe, add_special_tokens=False).ids
        if whole != [i for w in probe.split() for i in tok.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer joins tokens across white space; it can't be used chunk by chunk")
        dtype = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        pieces = _Pieces(tok)
        plain = [w for w in probe.split() if _PLAIN.fullmatch(w)]
        by_piece = pieces.of_chunks(plain, dtype)[0].tolist() == [i for w in plain for i in tok.encode(w, add_special_tokens=False).ids]
        added = [t.content for t in tok.get_added_tokens_decoder().values()]

        def whole_chunks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return ragged([e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)], dtype)

        def ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not by_piece:
                return whole_chunks(words)
            text = "\n".join(words)
            if not _OTHER.search(text) and not any(x in text for x in added):
                return pieces.of_chunks(words, dtype)
            odd = [not _PLAIN.fullmatch(w) or any(x in w for x in added) for w in words]
            flat, sizes = pieces.of_chunks(["" if o else w for w, o in zip(words, odd, strict=True)], dtype)
            more, more_sizes = whole_chunks([w for w, o in zip(words, odd, strict=True) if o])
            at = np.repeat(np.cumsum(sizes)[odd], more_sizes)
            sizes[odd] = more_sizes
            return np.insert(flat, at, more), sizes
        return ChunkTable(ids, dtype, limit=100_000)
    return shared_table(("tokens", path), make)
