"""The pipeline's stages on the smallest tables, each against what it must keep."""

import corpus_pipeline as cp
from curatio.llm.common import read_table, written
from tests.conftest import SF_SMALL
from tests.llm.test_operators import words


def test_stages(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    rows, seen = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), name)
        seen[name] = docs
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    for name in list(seen)[:-1]:
        assert seen[name].columns == cp.COLUMNS
    kept = {r.doc_id: r.text for r in seen["language_id"].collect()}
    assert all(rows[i] == t for i, t in kept.items()) and len(kept) >= 0.95 * len(rows)
    lines = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert all(set(t.split("\n")) <= set(kept[i].split("\n")) for i, t in lines.items())
    single = {r.doc_id: r.text for r in seen["minhash_near_dedup"].collect()}
    assert len({" ".join(t.lower().split()) for t in single.values()}) == len(single)
    mixed = seen["mixing"].collect()
    assert all(single[r.doc_id] == r.text for r in mixed)
    pieces = seen["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed}
    starts = [r for r in pieces if r.start == 0]
    assert len(starts) == len(mixed) and sum(r.doc_tokens for r in starts) == sum(r.length for r in pieces)


def test_lines_extend_matches(spark):
    """Passages of over 50 words go whole wherever their borders lie, on one line or several."""
    many = [words(900 + i, 9) for i in range(7)]
    single = words(950, 60)
    rows = [(i, [words(i, 5), words(i + 50, 4), *many, words(i + 90, 3), words(i + 120, 6)]) for i in range(12)]
    rows += [(20 + i, [words(i + 200, 4), single, words(i + 250, 5)]) for i in range(12)]
    rows += [(60, [*many, words(400, 3), *many]), (61, [words(401, 4), "", words(402, 3)]), (62, [words(403, 4), "", words(402, 3)])]
    rows += [(70 + i, [words(500 + 7 * i + k, 20) for k in range(7)]) for i in range(3)]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 1) for i, t in rows] + [(80, None, "en", "s", 1), (81, "", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in cp.lines(spark, docs, "").collect()}
    want = {i: t if i in (0, 20) else [x for x in t if x not in many and x != single] for i, t in rows}
    assert got.pop(80, "") is None and got.pop(81) == ""
    assert got == {i: "\n".join(t) for i, t in want.items() if t}


def test_lines_take_copies_whole(spark):
    """A copy loses every line, its one-line chunks too, or none; no scraps of it are left."""
    texts = [[words(300 + 40 * k + i, 2 if i % 3 else 12) for i in range(25)] for k in range(4)] + [["a b", "c d", "e f"]]
    rows = [(10 * k + c, "\n".join(t)) for k, t in enumerate(texts) for c in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in cp.lines(spark, docs, "").collect()}
    assert all(got[10 * k] == "\n".join(t) for k, t in enumerate(texts))
    assert all(i % 10 == 0 or got.get(i) in (None, "\n".join(texts[4])) for i, _ in rows)
    assert not any(i in got for i, _ in rows if i < 40 and i % 10)
