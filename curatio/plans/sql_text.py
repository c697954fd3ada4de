"""DuckDB expression builders mirroring ``curatio.functions.text`` and the parse rules.

Used only to write the oracle SQL the driver checks our Spark results against.
"""

from __future__ import annotations

from curatio.functions.text import DROP_LAST_RE, LSTRIP_RE, RSTRIP_RE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rs(x: str) -> str:
    return f"regexp_replace({x}, {q(RSTRIP_RE)}, '')"


def ls(x: str) -> str:
    return f"regexp_replace({x}, {q(LSTRIP_RE)}, '')"


def st(x: str) -> str:
    return ls(rs(x))


def head(x: str, m: str) -> str:
    return f"split_part({x}, {q(m)}, 1)"


def count_of(x: str, m: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(m)}, ''))) // {len(m)})"


def two(x: str, m: str) -> str:
    return f"({count_of(x, m)} = 1)"


def after(x: str, m: str) -> str:
    return f"split_part({x}, {q(m)}, 2)"


def drop_last(x: str) -> str:
    return f"regexp_replace({x}, {q(DROP_LAST_RE)}, '')"


def choice_label(tail: str) -> str:
    piece = st(f"string_split_regex({tail}, '\\(.\\)')[2]")
    return (f"(case when {piece} is null or length({piece}) = 0 then ' ' "
            f"when ends_with({piece}, '.') then {drop_last(piece)} else {piece} end)")


def paren_label(tail: str) -> str:
    span = f"regexp_extract({tail}, '\\(.*\\)', 0)"
    return f"(case when length({span}) = 0 then ' ' else {span} end)"


def parse_select(dataset: str, model: str, out: str = "output") -> tuple[str, str]:
    """(rationale_sql, label_sql) for a dataset/model pair; bad CQA/palm rows give NULL."""
    fam = "anli" if dataset.startswith("anli") else dataset
    if fam == "cqa":
        rl = rs(head(out, "Q:")) if model == "palm" else st(head(out, "Q:"))
        ok = two(rl, "So the answer is")
        bad_r = "NULL" if model == "palm" else "' '"
        return (f"(case when {ok} then {rs(head(rl, 'So the answer is'))} else {bad_r} end)",
                f"(case when {ok} then {choice_label(after(rl, 'So the answer is'))} else {bad_r} end)")
    if fam in ("svamp", "asdiv"):
        rl = rs(head(out, "Q:")) if model == "palm" else st(head(out, "Q:"))
        ok = two(rl, "The answer is")
        return (f"(case when {ok} then {rs(head(rl, 'The answer is'))} else ' ' end)",
                f"(case when {ok} then {paren_label(after(rl, 'The answer is'))} else ' ' end)")
    if fam == "esnli":
        r = head(out, "Answer:")
        rat = rs(r) if model == "palm" else st(r)
        piece = f"string_split({out}, 'Answer: ')[2]"
        return rat, f"coalesce({rs(head(piece, 'Premise'))}, ' ')"
    if fam == "anli":
        rl = rs(head(out, "Premise:")) if model == "palm" else st(head(out, "Premise:"))
        ok1 = two(rl, "So the answer is")
        r1, l1 = rs(head(rl, "So the answer is")), drop_last(ls(after(rl, "So the answer is")))
        if model == "palm":
            return (f"(case when {ok1} then {r1} else '' end)", f"(case when {ok1} then {l1} else '' end)")
        ok2 = two(rl, "The answer is")
        r2, l2 = rs(head(rl, "The answer is")), drop_last(ls(after(rl, "The answer is")))
        return (f"(case when {ok1} then {r1} when {ok2} then {r2} else '' end)",
                f"(case when {ok1} then {l1} when {ok2} then {l2} else '' end)")
    raise ValueError(dataset)
