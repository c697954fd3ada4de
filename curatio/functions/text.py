"""String helpers as native Column expressions (no Python per row).

The patterns below are written so that the same text works in Java regex (Spark) and RE2
(DuckDB, used by the oracle): explicit character classes, ``\\A``/``\\z`` anchors, and
``(?d)`` where Java's ``.`` must stop only at ``\\n`` like Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
# Characters Python's str.isspace() accepts (what str.strip/rstrip/lstrip/split remove):
# U+0009 U+000A U+000B U+000C U+000D U+001C U+001D U+001E U+001F U+0020 U+0085 U+00A0
# U+1680 U+2000..U+200A U+2028 U+2029 U+202F U+205F U+3000
WS_CLASS = (r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# ------------------------------------------------------------------------------------

RSTRIP_RE = WS_CLASS + r"+\z"
LSTRIP_RE = r"\A" + WS_CLASS + "+"
WORD_SPLIT_RE = WS_CLASS + "+"
DROP_LAST_RE = r"(?s).\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rstrip(x) -> Column:
    """Python ``str.rstrip()``."""
    return F.regexp_replace(_c(x), RSTRIP_RE, "")


def lstrip(x) -> Column:
    """Python ``str.lstrip()``."""
    return F.regexp_replace(_c(x), LSTRIP_RE, "")


def strip(x) -> Column:
    """Python ``str.strip()``."""
    return lstrip(rstrip(x))


def head(x, marker: str) -> Column:
    """Python ``s.split(marker)[0]``: text before the first marker, all of it when absent."""
    return F.substring_index(_c(x), marker, 1)


def count_of(x, marker: str) -> Column:
    """Non-overlapping occurrences of a literal marker (what ``str.split`` splits on)."""
    c = _c(x)
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker))


def splits_in_two(x, marker: str) -> Column:
    """True when ``a, b = s.split(marker)`` would succeed (exactly one marker)."""
    return count_of(x, marker) == 1


def before(x, marker: str) -> Column:
    return F.substring_index(_c(x), marker, 1)


def after_last(x, marker: str) -> Column:
    return F.substring_index(_c(x), marker, -1)


def nth_piece(x, marker: str, i: int) -> Column:
    """Python ``s.split(marker)[i]`` or NULL when there are not enough pieces.

    ``marker`` is a literal; it is regex-quoted for Spark's regex ``split``.
    """
    import re

    return F.get(F.split(_c(x), re.escape(marker), -1), i)


def drop_last_char(x) -> Column:
    """Python ``s[:-1]``."""
    return F.regexp_replace(_c(x), DROP_LAST_RE, "")


def words(x) -> Column:
    """Python ``s.split()``: runs of non-space characters, no empty strings."""
    return F.filter(F.split(_c(x), WORD_SPLIT_RE, -1), lambda w: F.length(w) > 0)


def basename(x) -> Column:
    """``os.path.basename``: text after the last ``/``."""
    return F.substring_index(_c(x), "/", -1)


def py_str(x) -> Column:
    """An f-string field: NULL prints as ``None``."""
    return F.coalesce(_c(x).cast("string"), F.lit("None"))
