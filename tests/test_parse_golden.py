"""Golden rows for E01–E09 (FIXTURES.md §4), hand-derived from the reference's parsing rules."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.utils import CapturedException

from curatio.operators.parse import parse_outputs

OPS = {"E01": ("cqa", "palm"), "E02": ("cqa", "gpt"), "E03": ("svamp", "palm"), "E04": ("svamp", "gpt"),
       "E05": ("asdiv", "palm"), "E06": ("esnli", "palm"), "E07": ("esnli", "gpt"),
       "E08": ("anli1", "palm"), "E09": ("anli1", "gpt")}

GOLDEN = [
    ("E01", "Rat. So the answer is (a) desk.\n\nQ: next", "Rat.", "desk"),
    ("E02", "  R So the answer is (b) x y. ", "R", "x y"),
    ("E01", "  R So the answer is (b) x y. ", "  R", "x y"),
    ("E02", "no marker", " ", " "),
    ("E02", "a So the answer is (a) b So the answer is (c) d", " ", " "),
    ("E01", "R So the answer is desk.", "R", " "),
    ("E01", "R So the answer is (a) Q: z", "R", " "),
    ("E01", "R So the answer is (c) a (d) b.", "R", "a"),
    ("E01", "R So the answer is (a) e.g..", "R", "e.g."),
    ("E02", "Q: So the answer is (a) b", " ", " "),
    ("E03", "He had 8. The answer is (8 - 3) = 5 (five).\n\nQ:", "He had 8.", "(8 - 3) = 5 (five)"),
    ("E04", "x The answer is 5.", "x", " "),
    ("E03", "So the answer is (1)", " ", " "),
    ("E03", "x The answer is (1\n+2)", "x", " "),
    ("E04", " x The answer is (1\r+2)", "x", "(1\r+2)"),
    ("E03", " x  The answer is (2)", " x", "(2)"),
    ("E05", " x  The answer is (2)", " x", "(2)"),
    ("E06", "R text\nAnswer: entailment\n\nPremise: next", "R text", "entailment"),
    ("E06", "R Answer:neutral", "R", " "),
    ("E06", "R only", "R only", " "),
    ("E06", "R Answer: ", "R", ""),
    ("E06", "R Answer: a Answer: b Premise", "R", "a"),
    ("E07", " R Answer: x", "R", "x"),
    ("E06", " R Answer: x", " R", "x"),
    ("E08", "R. So the answer is contradiction.\n\nPremise: q", "R.", "contradiction"),
    ("E08", "R. So the answer is neutral", "R.", "neutra"),
    ("E08", "none", "", ""),
    ("E08", "R So the answer is  \n", "R", ""),
    ("E08", "R The answer is neutral.", "", ""),
    ("E09", "R The answer is neutral.", "R", "neutral"),
    ("E09", "A So the answer is x. So the answer is y. The answer is z.",
     "A So the answer is x. So the answer is y.", "z"),
    # Unicode spaces are stripped like Python's str.strip()
    ("E02", "　R  So the answer is (a) x ", "R", "x"),
]


@pytest.mark.parametrize("op", sorted(OPS))
def test_golden_rows(spark, op):
    rows = [(i, o) for i, (k, o, _, _) in enumerate(GOLDEN) if k == op]
    if not rows:
        pytest.skip("no golden row")
    ds, model = OPS[op]
    df = spark.createDataFrame(rows, "i int, output string")
    got = {r.i: (r.rationale, r.label) for r in parse_outputs(df, ds, model).collect()}
    for i, _ in rows:
        assert got[i] == (GOLDEN[i][2], GOLDEN[i][3]), (op, GOLDEN[i][1])


def test_cqa_palm_bad_output_fails(spark):
    df = spark.createDataFrame([("no marker",)], "output string")
    with pytest.raises((PySparkException, CapturedException, Exception)) as e:
        parse_outputs(df, "cqa", "palm").collect()
    assert "So the answer is" in str(e.value)


def test_cqa_palm_quarantine_keeps_rows(spark):
    df = spark.createDataFrame([("no marker",), ("R So the answer is (a) b",)], "output string")
    rows = {r.output: r for r in parse_outputs(df, "cqa", "palm", on_bad="quarantine").collect()}
    bad, good = rows["no marker"], rows["R So the answer is (a) b"]
    assert bad.rationale is None and bad.parse_error is not None
    assert (good.rationale, good.label, good.parse_error) == ("R", "b", None)


def test_asdiv_gpt_is_rejected(spark):
    df = spark.createDataFrame([("x",)], "output string")
    with pytest.raises(ValueError):
        parse_outputs(df, "asdiv", "gpt")


def test_never_null_for_non_null_input(spark):
    outs = [o for _, o, _, _ in GOLDEN] + ["", " ", "Q:", "Premise:", "()", "(", "The answer is"]
    df = spark.createDataFrame([(o,) for o in outs], "output string")
    for ds, model in set(OPS.values()):
        on_bad = "blank" if (ds, model) == ("cqa", "palm") else "fail"
        for r in parse_outputs(df, ds, model, on_bad=on_bad).collect():
            assert r.rationale is not None and r.label is not None, (ds, model, r.output)
