"""The compiler against a small evaluator of Python values, over the cross product of types."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions.expressions import ExpressionError, Typed, bind_names, parse, preview, rewrite_binds


def num(v):
    if v is None or isinstance(v, (int, float)) and not isinstance(v, bool):
        return v
    if isinstance(v, bool):
        return int(v)
    try:
        return float(v.strip())
    except ValueError:
        return None


def text(v):
    return "true" if v is True else "false" if v is False else str(v)


def truth(v):
    return v not in (None, False, 0, 0.0, "")


def evaluate(node, env):
    if node.op == "literal":
        return node.value
    if node.op == "column":
        return env[node.value]
    p = [evaluate(x, env) for x in node.parts]
    if node.op == "not":
        return not truth(p[0])
    if node.op == "unary":
        return None if num(p[0]) is None else -num(p[0]) if node.value == "-" else num(p[0])
    if node.op == "if":
        return p[1] if truth(p[0]) else p[2]
    a, b = p
    op = node.value
    if op == "&&":
        return truth(a) and truth(b)
    if op == "||":
        return truth(a) or truth(b)
    if op == "??":
        return a if a is not None else b
    if op in ("==", "!="):
        same = a is None and b is None if None in (a, b) else isinstance(a, str) == isinstance(b, str) and (a == b)
        return same if op == "==" else not same
    if a is None or b is None:
        return None
    if op in ("<", "<=", ">", ">="):
        if isinstance(a, str) or isinstance(b, str):
            a, b = text(a), text(b)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op == "+" and (isinstance(a, str) or isinstance(b, str)):
        return text(a) + text(b)
    a, b = num(a), num(b)
    if a is None or b is None or op in "/%" and b == 0:
        return None
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()


COLUMNS = {"i": ("bigint", "integer", [7, 0, -3, None]), "j": ("bigint", "integer", [3, -2, 0, 5]), "b": ("boolean", "boolean", [True, False, None, True]), "s": ("string", "string", ["12", "", "x", None]), "z": ("string", "string", [" 3 ", "x", None, "-1"])}


@pytest.fixture(scope="module")
def frame(spark):
    rows = list(zip(*[c[2] for c in COLUMNS.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{n} {c[0]}" for n, c in COLUMNS.items()))
    return df, [dict(zip(COLUMNS, r)) for r in rows]


def run(frame, texts):
    df, _ = frame
    env = {n: Typed(F.col(n), c[1]) for n, c in COLUMNS.items()}
    return df.select(*[parse(t).column(env).col.alias(f"c{k}") for k, t in enumerate(texts)]).collect()


def agree(x, y):
    if isinstance(x, bool) or isinstance(y, bool) or x is None or y is None or isinstance(x, str):
        return x == y and isinstance(x, bool) == isinstance(y, bool)
    return math.isclose(x, y, rel_tol=1e-12)


def test_operators_over_types(frame):
    texts = [f"@{a} {op} @{b}" for a, b in itertools.product(COLUMNS, COLUMNS) for op in ("+", "-", "*", "/", "%", "==", "!=", "<", "<=", ">", ">=", "&&", "||")]
    rows = run(frame, texts)
    for env, row in zip(frame[1], rows):
        for k, t in enumerate(texts):
            assert agree(evaluate(parse(t).tree, env), row[k]), (t, env, row[k])


@pytest.mark.parametrize(
    "source, value",
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-7 % 3", 2), ("7 % -3", -2), ("1 / 0", None), ("10 - 2 - 3", 5), ("null ?? null ?? 4", 4), ("NOT null", True),
        ("not 1 == 2", True), ('"a" + 1', "a1"), ('"tab\\t"', "tab\t"), ("true ? 1 : 2", 1), ("false ? 1 : true ? 2 : 3", 2), ("1 < 2 && 2 < 3", True),
        ('SUBSTRING("abcdef", 2)', "cdef"), ('SUBSTRING("abcdef", 2, 2)', "cd"), ('SUBSTRING("abcdef", -2)', "ef"), ('SUBSTRING("ab", -9, 1)', "a"), ('SUBSTRING("abc", 1, -1)', "abc"[1:0]), ('SUBSTRING("abcdef", 1, -3)', "abcdef"[1:-2]), ('SUBSTRING("abc", 7)', ""),
        ('CONCAT("a", null, 1, true)', "a1true"), ('CONCAT_SEPARATOR("-", "a", null, "b")', "a--b"), ('LENGTH("日本")', 2), ("LENGTH(1234)", 4), ("LENGTH(null)", None), ('TRIM(" \\t x ")', "x"),
        ('TO_NUMBER("1e2")', 100.0), ('TO_NUMBER("x")', None), ("TO_NUMBER(true)", 1), ('TO_BOOL("false")', True), ('TO_BOOL("")', False), ('CONTAINS("abc", "b")', True), ("CONTAINS(null, 1)", None),
        ("COALESCE(null, null, 3)", 3), ('MD5("a")', "0cc175b9c0f1b6a831c399e269772661"), ('UPPER("ab")', "AB"), ("UPPER(null)", None), ("1 == 1.0", True), ('"1" == 1', False), ("true == 1", True), ("null == null", True),
    ],
)
def test_values(frame, source, value):
    assert run(frame, [source])[0][0] == value


@pytest.mark.parametrize("bad", ["", "1 +", "@a = 1", "!@a", "name", "NOPE(1)", "UPPER()", "SUBSTRING(1)", "(1", "1 2", "@", "1 ? 2", '"open'])
def test_errors(bad):
    with pytest.raises(ExpressionError):
        parse(bad)


def test_unknown_column(frame):
    with pytest.raises(ExpressionError):
        run(frame, ["@nothing"])


def test_binds():
    source = '@a + "@b" + @c + \'@d\' + @a'
    assert bind_names(source) == ["a", "c"]
    assert parse("@x + @y + @x").references == ("x", "y")
    assert rewrite_binds(source) == "row.`a` + \"@b\" + row.`c` + '@d' + row.`a`"


def test_preview(spark):
    assert preview(spark, "@a + @b", {"a": 1, "b": "x"}) == {"references": ["a", "b"], "result": "1x"}
    assert preview(spark, "@a ?? LENGTH(@l)", {"a": None, "l": ["x", "y"]})["result"] == 2
    assert "error" in preview(spark, "@a +", {"a": 1})
