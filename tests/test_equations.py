import pytest

from curatio.functions.equation import evaluate
from curatio.operators.equations import equation_values
from curatio.operators.metrics import equation_accuracy, text_accuracy

CASES = [(" (10+3)", 13.0), ("( 8.0 - 3.0 )", 5.0), ("9", 9.0), ("1,000", 1.0), ("[1,2]", 1.0),
         ("007", None), ("1/0", None), (" ", None), ("3%", None), ("2**3", 8.0), ("()", None),
         ("(1\r+2)", 3.0), ("-(4)/8", -0.5), ("__import__('os')", None), ("True", None), (None, None)]


@pytest.mark.parametrize("text,value", CASES)
def test_evaluate(text, value):
    assert evaluate(text) == value


def test_equation_values_distinct_first(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES if t is not None] * 3, "equation string")
    got = {r.equation: r.value for r in equation_values(df).collect()}
    assert len(got) == len([t for t, _ in CASES if t is not None])
    for t, v in CASES:
        if t is not None:
            assert got[t] == v


def test_nulls_never_match_but_blanks_do(spark):
    df = spark.createDataFrame([("1/0", "1/0"), ("2", "1+1"), (" ", " ")], "p string, l string")
    acc = equation_accuracy(df, "p", "l").collect()[0]
    assert acc.accuracy == pytest.approx(1 / 3)
    t = text_accuracy(df, "p", "l", group=()).collect()[0]
    assert t.accuracy == pytest.approx(2 / 3)


def test_empty_input_gives_null(spark):
    df = spark.createDataFrame([], "p string, l string")
    assert text_accuracy(df, "p", "l", group=()).collect()[0].accuracy is None


def test_long_and_deep_equations():
    assert evaluate("+".join(["1"] * 10_000)) == 10_000.0
    assert evaluate("-".join(["1"] * 30_000)) == 1.0 - 29_999
    assert evaluate("(" * 5_000 + "2" + ")" * 5_000 + "*3") == 6.0
    assert evaluate("-" * 4_001 + "7") == -7.0
    assert evaluate("(" * 500 + "1" + ")" * 499) is None


def test_floor_modulo_power():
    assert [evaluate(x) for x in ("7//2", "7%4", "2**3", "-2**2", "2**-1", "2**3**2", "-7//2")] == [3, 3, 8, -4, 0.5, 512, -4]
    assert [evaluate(x) for x in ("9**9**9", "(-8)**0.5", "1%0", "1//0", "0**-1")] == [None] * 5


def test_both_evaluators_agree():
    from curatio.functions.equation import _by_precedence, _value
    for x in ("1+2*3", "(1+2)*3", "-2**2", "2**-1*3", "1,000", "(1,2)", "[3, 4]", "7 // 2 % 2", "1e3/4", ".5+1.", "((4))", "-(-3)", "(5,)", "1,"):
        assert _by_precedence(x) == _value(x), x
