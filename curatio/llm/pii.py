"""Personal data: fixed patterns, and spans added by a character-level BiLSTM-CRF.

The patterns' spans (``base``) always stay.  The network is trained from labelled spans:
windows of training texts with their base spans, and the same windows with spans rewritten
in ways that the patterns do not know (``_rewritten``).  It reads the windows around every
digit (of any script), every ``@`` and every word ``at`` (``marks``) of a whole text.
``_plausible`` takes no span without one of them, so the other windows hold nothing to find.  Windows overlap; a character's tag comes from the window in which
it lies most centrally, and spans are then put together over the whole text, so that a span
across windows is one span.  A decoded span is added if it overlaps no base span and has
what its kind needs (``_plausible``).

Edge cases: NULL or empty text has no span; without training windows nothing is added;
repeated rows give the same spans; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.bilstm_crf import Net
from curatio.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH = 96, 48, 28
TRAIN_DOCS, TRAIN_WINDOWS = 20_000, 1500

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails from its start fails from its middle too, hence the look-behind
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_OTHER_DIGITS = {i: str(unicodedata.digit(chr(i))) for i in range(128, sys.maxunicode + 1) if chr(i).isdigit()}
_SIGN = re.compile(r"[\d@]")
# digits that are not decimal, such as raised ones; apart by plane, as a set within one plane is looked up at once
_RARE = [re.compile(f"[{''.join(x)}]") for x in (
    [chr(i) for i in _OTHER_DIGITS if i < 1 << 16 and not chr(i).isdecimal()],
    [chr(i) for i in _OTHER_DIGITS if i >= 1 << 16 and not chr(i).isdecimal()]) if x]
# the word "at" in any brackets and between underscores, or capitals within a small word (nameAThost.com); looking
# behind last, as a pattern that starts with a letter is found faster
_AT = (re.compile(r"[Aa][Tt](?![^\W_])(?<![^\W_]..)"), re.compile(r"AT(?=[a-z0-9])(?<=[a-z0-9]AT)"))
Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@``, domain: looked up from each ``@``, so in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; offsets in code points, end exclusive."""
    if not _SIGN.search(text):
        return []
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# --- the network's view of a text ---------------------------------------------------------

_SIGNS = " \n@.+-()_%:,/=\"'"       # symbols with a code of their own


def _code(c: str) -> int:
    if c in _SIGNS:
        return 7 + _SIGNS.index(c)
    if c.isdigit():
        return 1
    if c.isalpha():
        return 2 + 2 * (not c.isascii()) + c.isupper()
    return 6


_ASCII = np.array([_code(chr(i)) for i in range(128)], np.int64)
SYMBOLS, TAGS = 7 + len(_SIGNS), 1 + 2 * len(KINDS)      # tags: 0 outside, 2k+1 begin, 2k+2 inside


def codes(text: str) -> np.ndarray:
    if text.isascii():
        return _ASCII[np.frombuffer(text.encode("ascii"), np.uint8)]
    return np.fromiter(map(_code, text), np.int64, len(text))


def marks(text: str) -> list[tuple[int, int]]:
    """Places of everything of which a span needs one, in order."""
    return sorted(m.span() for p in (_SIGN, *_AT, *([] if text.isascii() else _RARE)) for m in p.finditer(text))


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that cover everything near a digit, ``@`` or ``at``."""
    out: list[int] = []
    covered = -1
    for start, end in marks(text):
        lo, hi = max(0, start - REACH), min(len(text), end + REACH)
        if covered < lo:
            out.append(lo)
            covered = lo + WINDOW
        while covered < hi:
            out.append(out[-1] + STRIDE)
            covered = out[-1] + WINDOW
    return out


def _batch(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pieces])
    x = np.zeros((len(pieces), WINDOW), np.int64)
    for i, p in enumerate(pieces):
        x[i, :len(p)] = p
    return x, lengths


def _rewritten(kind: str, s: str, way: int) -> str:
    """The span as people also write it (and the patterns do not know it)."""
    d = _DIGITS.sub("", s)
    if kind == "email":
        return s.replace("@", (" @ ", " (at) ", "[at]")[way % 3])
    if kind == "ip":
        return s.replace(".", (" . ", ". ")[way % 2])
    if kind == "card":
        return (".", "/")[way % 2].join(d[i:i + 4] for i in range(0, len(d), 4))
    area, mid, last = d[-10:-7], d[-7:-4], d[-4:]
    return (f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"00{d}", f"{area}.{mid}.{last}")[way % 4]


def _tagged(text: str, spans: list[Span], lo: int) -> tuple[str, np.ndarray]:
    tags = np.zeros(WINDOW, np.int64)
    for kind, s, e in spans:
        k = 2 * KINDS.index(kind) + 1
        a, b = max(s - lo, 0), min(e - lo, WINDOW)
        if a < b:
            tags[a:b] = k + 1
            if s >= lo:
                tags[a] = k
    return text[lo:lo + WINDOW], tags


def training_windows(text: str) -> Iterator[tuple[str, list[int], bool]]:
    """(window, tags, has a span): plain windows, and the same with one span rewritten."""
    base, end = [], 0
    for x in base_spans(text):       # overlapping kinds: the first stands
        if x[1] >= end:
            base.append(x)
            end = x[2]
    for lo in windows_of(text):
        near = [x for x in base if x[1] < lo + WINDOW and x[2] > lo]
        w, tags = _tagged(text, near, lo)
        yield w, tags[:len(w)].tolist(), bool(near)
        for way, (kind, s, e) in enumerate(near):
            new = _rewritten(kind, text[s:e], s + way)
            left = max(0, s - REACH)
            moved = text[left:s] + new + text[e:e + WINDOW]
            keep = [(k, a - left, b - left) for k, a, b in near if b <= s and a >= left] + [(kind, s - left, s - left + len(new))]
            keep += [(k, a - e + s + len(new) - left, b - e + s + len(new) - left) for k, a, b in near if a >= e]
            w, tags = _tagged(moved, keep, 0)
            yield w, tags[:len(w)].tolist(), True


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS,
          max_windows: int = TRAIN_WINDOWS) -> Net | None:
    """Fit on at most ``max_windows`` windows with and as many without spans.

    They come from about ``max_docs`` texts chosen by a hash of the id: documented bounds on
    the fit alone; every given text is searched.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = rows.select(F.count(F.lit(1))).first()[0]
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, max_docs / max(n, 1)) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            got = [x for t in texts for x in training_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()),
                                              pa.array([x[1] for x in got], pa.list_(pa.int64())),
                                              pa.array([x[2] for x in got], pa.bool_())], ["w", "tags", "some"])
    wins = rows.select("text").mapInArrow(run, "w string, tags array<long>, some boolean").distinct()
    order = [F.xxhash64("w"), F.col("w"), F.col("tags")]
    got = [r for some in (True, False) for r in wins.where(F.col("some") == some).orderBy(*order).limit(max_windows).collect()]
    if not any(r.some for r in got):
        return None
    x, lengths = _batch([codes(r.w) for r in got])
    y, _ = _batch([np.array(r.tags, np.int64) for r in got])
    net = Net(SYMBOLS, TAGS)
    net.fit(x, y, lengths)
    return net


def _plausible(kind: str, s: str) -> bool:
    s = s.translate(_OTHER_DIGITS)
    d = _DIGITS.sub("", s)
    if kind == "email":
        return "." in s and ("@" in s or any(p.search(s) for p in _AT)) and not d == s
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^\W\d]", s)
    if re.search(r"[^0-9\s().+/-]", s):
        return False
    return 14 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def _tag_windows(net: Net, texts: list[str], batch: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, positions, tags) of each text that has windows, reconciled."""
    jobs = [(i, lo) for i, t in enumerate(texts) for lo in windows_of(t)]
    cache: dict[str, np.ndarray] = {}
    todo = list(dict.fromkeys(texts[i][lo:lo + WINDOW] for i, lo in jobs))
    for k in range(0, len(todo), batch):
        x, lengths = _batch([codes(w) for w in todo[k:k + batch]])
        cache.update(zip(todo[k:k + batch], net.decode(x, lengths), strict=True))
    k = 0
    while k < len(jobs):
        i, n = jobs[k][0], k
        while n < len(jobs) and jobs[n][0] == i:
            n += 1
        starts = np.array([lo for _, lo in jobs[k:n]])
        size = np.minimum(starts + WINDOW, len(texts[i])) - starts
        tags = np.concatenate([cache[texts[i][lo:lo + WINDOW]][:m] for lo, m in zip(starts, size, strict=True)])
        at = np.concatenate([np.arange(lo, lo + m) for lo, m in zip(starts, size, strict=True)])
        away = np.abs(at - np.repeat(starts + WINDOW // 2, size))
        order = np.lexsort((away, at))
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        yield i, at[order][first], tags[order][first]
        k = n


def added_spans(net: Net, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Plausible spans of the network that overlap no base span, for each text."""
    out: list[list[Span]] = [[] for _ in texts]
    for i, at, tags in _tag_windows(net, texts):
        kind = (tags + 1) // 2      # 0 outside, else 1 + kind
        fresh = np.diff(at, prepend=-9) > 1
        new = fresh | (np.diff(kind, prepend=0) != 0) | ((tags % 2 == 1) & (tags > 0))
        cuts = np.flatnonzero(new)
        for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
            if not kind[a]:
                continue
            s, e = int(at[a]), int(at[b - 1]) + 1
            text = texts[i][s:e]
            s += len(text) - len(text.lstrip(" \n.,:;-)'\""))
            e -= len(text) - len(text.rstrip(" \n.,:;-('\""))
            name = KINDS[kind[a] - 1]
            if s < e and _plausible(name, texts[i][s:e]) and not any(x[1] < e and x[2] > s for x in base[i]):
                out[i].append((name, s, e))
    return out


def find(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, added) of every whole text, by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(net.w if net else None)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        model = Net(SYMBOLS, TAGS, w=weights) if weights else None
        for part, texts in text_slices(batches):
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base) if model else [[] for _ in texts]
            rows = [[{"kind": k, "start": s, "end": e, "added": a} for (k, s, e), a in
                     sorted([(x, False) for x in b] + [(x, True) for x in m], key=lambda x: (x[0][1], KINDS.index(x[0][0])))]
                    for b, m in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,added:boolean>>")
