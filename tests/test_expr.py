import pytest

from bitloom.functions import expr


def test_counts():
    v = {"a": 7, "b": 2, "max": 9, "min": 4, "count": 3, "h": {"n": 5}}
    assert expr.evaluate("a - b", v) == 5 and expr.evaluate("a / b", v) == 3 and expr.evaluate("(max - min + 1) * count", v) == 18
    assert expr.evaluate("(b - a) / b", v) == -2 and expr.evaluate("h.n * 2", v) == 10 and expr.evaluate("1 + 2 * 3", v) == 7


@pytest.mark.parametrize("text,kind", [("a / 0", "division_by_zero"), ("zz + 1", "undefined_field"), ("a +", "parse_error"), ("(a", "parse_error"), ("a % 2", "parse_error"), ("a b", "parse_error"), ("h + 1", "invalid_operand")])
def test_errors(text, kind):
    with pytest.raises(expr.ExprError) as e:
        expr.evaluate(text, {"a": 7, "h": {"n": 5}})
    assert e.value.kind == kind


def test_conditions_in_python_and_as_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, ["x", "SIZE", None][i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "n long, s string")
    for text in ("n & 1", "n & 6 == 6", "(n & 6) == 6", "n > 3 && n <= 8 || n == 0", "!(n > 5)", "n << 1 >= 0x0A", "s == 'SIZE'", "s != 'SIZE' && n < 9", "-n < -3"):
        tree = expr.parse(text)
        run = expr.compiled(tree)

        def local(n, s):
            try:
                return bool(run(lambda k: {"n": n, "s": s}[k])) if s is not None or "s" not in expr.names(tree) else None
            except expr.ExprError:
                return False

        got = [r[0] for r in df.orderBy("n").select(expr.condition(tree, F.col)).collect()]
        assert all(w is None or g == w for g, w in zip(got, [local(n, s) for n, s in rows])), text
