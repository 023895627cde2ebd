"""The expression language for computed properties: text -> tree -> typed Spark column.

Operators, from loose to tight: `c ? a : b`, `??`, `|| OR`, `&& AND`, `NOT`, `== !=`,
`< <= > >=`, `+ -`, `* / %`, unary `- +`. Operands: numbers, texts in single or double quotes,
@column, true, false, null, FUNCTION(...), parentheses. Types are resolved when compiling, as a
Spark column has one type; the rules of the language (null-safe equality, text concatenation by
`+`, modulo with the sign of the divisor, two-valued logic) are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import WHITE_SPACE, strip


class ExpressionError(ValueError):
    """A text that is no valid expression, or one whose types do not fit."""


@dataclass(frozen=True)
class Node:
    """op: literal, column, call, unary, binary, not, if."""

    op: str
    value: object = None
    parts: tuple[Node, ...] = ()


_LEX = re.compile(
    r"""\s*(?:
      (?P<number>\d+\.\d+|\d+)
    | (?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    | @(?P<column>[A-Za-z_]\w*)
    | (?P<name>[A-Za-z_]\w*)
    | (?P<mark>\?\?|\|\||&&|==|!=|<=|>=|[-+*/%<>?:(),])
    )""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: Binding strength of binary operators.
_BINARY = {"??": 2, "||": 3, "&&": 4, "==": 6, "!=": 6, "<": 7, "<=": 7, ">": 7, ">=": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
_TERNARY, _NOT, _UNARY = 1, 5, 10


def _lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].lstrip()[:1]!r} at {at} in {text!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "number":
            value = float(value) if "." in value else int(value)
        elif kind == "text":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        elif kind == "name" and value.lower() in ("and", "or", "not"):
            kind, value = "mark", {"and": "&&", "or": "||", "not": "NOT"}[value.lower()]
        elif kind == "name" and value.lower() in ("true", "false", "null"):
            kind, value = "constant", {"true": True, "false": False, "null": None}[value.lower()]
        out.append((kind, value))
        at = m.end()
    return [*out, ("end", None)]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _lex(text), 0

    def take(self, kind: str | None = None, value: object = None) -> tuple[str, object]:
        token = self.tokens[self.at]
        if kind and (token[0] != kind or token[1] != value):
            raise ExpressionError(f"expected {value!r}, found {token[1]!r} in {self.text!r}")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.expression(0)
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return node

    def expression(self, least: int) -> Node:
        left = self.operand()
        while True:
            kind, value = self.tokens[self.at]
            if kind != "mark":
                return left
            if value == "?" and least <= _TERNARY:
                self.take()
                then = self.expression(0)
                self.take("mark", ":")
                left = Node("if", None, (left, then, self.expression(_TERNARY)))
                continue
            power = _BINARY.get(value)
            if power is None or power < least:
                return left
            self.take()
            left = Node("binary", value, (left, self.expression(power + 1)))

    def operand(self) -> Node:
        kind, value = self.take()
        if kind in ("number", "text", "constant"):
            return Node("literal", value)
        if kind == "column":
            return Node("column", value)
        if kind == "mark" and value == "NOT":
            return Node("not", None, (self.expression(_NOT),))
        if kind == "mark" and value in ("-", "+"):
            return Node("unary", value, (self.expression(_UNARY),))
        if kind == "mark" and value == "(":
            node = self.expression(0)
            self.take("mark", ")")
            return node
        if kind == "name":
            return self.call(str(value))
        raise ExpressionError(f"unexpected {value!r} in {self.text!r}" if kind != "end" else f"unexpected end of {self.text!r}")

    def call(self, name: str) -> Node:
        if self.tokens[self.at] != ("mark", "("):
            raise ExpressionError(f"bare name {name!r}; columns are written @{name}")
        self.take()
        args: list[Node] = []
        if self.tokens[self.at] != ("mark", ")"):
            args.append(self.expression(0))
            while self.tokens[self.at] == ("mark", ","):
                self.take()
                args.append(self.expression(0))
        self.take("mark", ")")
        return Node("call", name.upper(), tuple(args))


@dataclass(frozen=True)
class Typed:
    """A column with its static type: integer, float, boolean, string, array, object or null."""

    col: Column
    kind: str

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "float", "boolean")


def to_text(v: Typed) -> Column:
    """Text form, NULL for NULL: true/false for booleans, JSON for arrays and objects."""
    if v.kind == "null":
        return F.lit(None).cast("string")
    if v.kind in ("array", "object"):
        return F.to_json(v.col)
    return v.col.cast("string")


def to_number(v: Typed) -> Typed:
    """Number form: booleans are 0 and 1, texts are trimmed and read as a float, NULL if they are
    no number."""
    if v.kind in ("integer", "float"):
        return v
    if v.kind == "boolean":
        return Typed(v.col.cast("int").cast("bigint"), "integer")
    if v.kind == "string":
        text = strip(v.col)
        return Typed(F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")), "float")
    return Typed(F.lit(None).cast("double"), "float")


def truthy(v: Typed) -> Column:
    """NULL, false, 0, empty text and empty array are false; everything else is true."""
    if v.kind == "null":
        return F.lit(False)
    tests = {"boolean": v.col, "integer": v.col != 0, "float": v.col != 0, "string": v.col != ""} if v.kind not in ("array", "object") else {}
    test = tests[v.kind] if tests else (F.size(v.col) > 0 if v.kind == "array" else v.col.isNotNull())
    return F.coalesce(test, F.lit(False))


def _joined_kind(values: list[Typed]) -> str:
    kinds = {v.kind for v in values} - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {"integer", "float"}:
        return "float"
    return "string"


def _as_kind(v: Typed, kind: str) -> Column:
    spark = {"integer": "bigint", "float": "double", "boolean": "boolean", "string": "string", "array": "array<string>", "object": "variant", "null": "string"}[kind]
    if v.kind == "null":
        return F.lit(None).cast(spark)
    if v.kind == kind:
        return v.col
    return to_text(v) if kind == "string" else v.col.cast(spark)


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and "string" in (a.kind, b.kind):
        return Typed(F.concat(to_text(a), to_text(b)), "string")
    a, b = to_number(a), to_number(b)
    kind = "integer" if a.kind == b.kind == "integer" else "float"
    x, y = _as_kind(a, kind), _as_kind(b, kind)
    if op == "+":
        return Typed(F.try_add(x, y), kind)
    if op == "-":
        return Typed(F.try_subtract(x, y), kind)
    if op == "*":
        return Typed(F.try_multiply(x, y), kind)
    if op == "/":
        return Typed(F.try_divide(x.cast("double"), y.cast("double")), "float")
    rest = F.try_mod(x, y)
    return Typed(F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest), kind)


def _equal(a: Typed, b: Typed) -> Column:
    if "null" in (a.kind, b.kind):
        return (a.col if b.kind == "null" else b.col).isNull() if a.kind != b.kind else F.lit(True)
    if a.kind == b.kind and a.kind != "object":
        return a.col.eqNullSafe(b.col)
    if a.numeric and b.numeric:
        return to_number(a).col.eqNullSafe(to_number(b).col)
    if a.kind == b.kind:
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    return a.col.isNull() & b.col.isNull()  # values of different types are never equal


def _compare(op: str, a: Typed, b: Typed) -> Column:
    if a.numeric and b.numeric:
        x, y = to_number(a).col, to_number(b).col
    else:
        x, y = to_text(a), to_text(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _text_or_empty(v: Typed) -> Column:
    return F.coalesce(to_text(v), F.lit(""))


def _substring(args: list[Typed]) -> Typed:
    text = to_text(args[0])
    at = F.coalesce(to_number(args[1]).col.cast("int"), F.lit(0))
    first = F.when(at < 0, F.greatest(F.char_length(text) + at, F.lit(0))).otherwise(at)
    rest = F.greatest(F.char_length(text) - first, F.lit(0))
    if len(args) == 2:
        size = rest
    else:
        asked = F.coalesce(to_number(args[2]).col.cast("int"), F.lit(0))
        # a negative length gives an end that counts from the end of the text where it is negative
        size = F.when(asked < 0, F.greatest(_slice_end(text, first + asked) - first, F.lit(0))).otherwise(asked)
    return Typed(F.substring(text, first + 1, size), "string")


def _slice_end(text: Column, end: Column) -> Column:
    return F.when(end < 0, F.greatest(F.char_length(text) + end, F.lit(0))).otherwise(end)


def _length(args: list[Typed]) -> Typed:
    v = args[0]
    if v.kind == "array":
        return Typed(F.when(v.col.isNotNull(), F.size(v.col)).cast("bigint"), "integer")
    if v.kind == "object":
        keys = F.size(F.json_object_keys(F.to_json(v.col)))
        return Typed(F.when(v.col.isNotNull(), keys).cast("bigint"), "integer")
    return Typed(F.char_length(to_text(v)).cast("bigint"), "integer")


def _trim(pattern: Callable[[Column], Column]) -> Callable[[list[Typed]], Typed]:
    return lambda args: Typed(pattern(to_text(args[0])), "string")


def _coalesce(args: list[Typed]) -> Typed:
    kind = _joined_kind(args)
    return Typed(F.coalesce(*[_as_kind(a, kind) for a in args]), kind)


def _unary_number(function: Callable[[Column], Column], kind: str | None = None) -> Callable[[list[Typed]], Typed]:
    def apply(args: list[Typed]) -> Typed:
        v = to_number(args[0])
        return Typed(function(v.col) if kind is None else function(v.col).cast("bigint"), kind or v.kind)

    return apply


#: name -> (least arguments, most arguments or None, function). The first block is the language's
#: own; the second replaces what would otherwise be sent to a database.
FUNCTIONS: dict[str, tuple[int, int | None, Callable[[list[Typed]], Typed]]] = {
    "CONCAT": (0, None, lambda a: Typed(F.concat(F.lit(""), *[_text_or_empty(x) for x in a]), "string")),
    "CONCAT_SEPARATOR": (1, None, lambda a: Typed(_join(a), "string")),
    "UPPER": (1, 1, lambda a: Typed(F.upper(to_text(a[0])), "string")),
    "LOWER": (1, 1, lambda a: Typed(F.lower(to_text(a[0])), "string")),
    "SUBSTRING": (2, 3, _substring),
    "LENGTH": (1, 1, _length),
    "LTRIM": (1, 1, _trim(lambda t: F.ltrim(t, F.lit(WHITE_SPACE)))),
    "RTRIM": (1, 1, _trim(lambda t: F.rtrim(t, F.lit(WHITE_SPACE)))),
    "TRIM": (1, 1, _trim(strip)),
    "TO_STRING": (1, 1, lambda a: Typed(to_text(a[0]), "string")),
    "TO_NUMBER": (1, 1, lambda a: to_number(a[0])),
    "TO_BOOL": (1, 1, lambda a: Typed(truthy(a[0]), "boolean")),
    "CONTAINS": (2, 2, lambda a: Typed(F.contains(to_text(a[0]), to_text(a[1])), "boolean")),
    "COALESCE": (0, None, lambda a: _coalesce(a) if a else Typed(F.lit(None), "null")),
    "NOT_NULL": (1, None, _coalesce),
    "MD5": (1, 1, lambda a: Typed(F.md5(to_text(a[0])), "string")),
    "SHA1": (1, 1, lambda a: Typed(F.sha1(to_text(a[0])), "string")),
    "SHA256": (1, 1, lambda a: Typed(F.sha2(to_text(a[0]), 256), "string")),
    "SHA512": (1, 1, lambda a: Typed(F.sha2(to_text(a[0]), 512), "string")),
    "LEFT": (2, 2, lambda a: Typed(F.substring(to_text(a[0]), F.lit(1), to_number(a[1]).col.cast("int")), "string")),
    "RIGHT": (2, 2, lambda a: Typed(F.right(to_text(a[0]), to_number(a[1]).col.cast("int")), "string")),
    "REVERSE": (1, 1, lambda a: Typed(F.reverse(to_text(a[0])), "string")),
    "SUBSTITUTE": (3, 3, lambda a: Typed(F.replace(to_text(a[0]), to_text(a[1]), to_text(a[2])), "string")),
    "SPLIT": (2, 2, lambda a: Typed(F.split(to_text(a[0]), F.concat(F.lit("\\Q"), to_text(a[1]), F.lit("\\E"))), "array")),
    "REGEX_TEST": (2, 2, lambda a: Typed(F.regexp_like(to_text(a[0]), to_text(a[1])), "boolean")),
    "REGEX_REPLACE": (3, 3, lambda a: Typed(F.regexp_replace(to_text(a[0]), to_text(a[1]), to_text(a[2])), "string")),
    "STARTS_WITH": (2, 2, lambda a: Typed(F.startswith(to_text(a[0]), to_text(a[1])), "boolean")),
    "ABS": (1, 1, _unary_number(F.abs)),
    "FLOOR": (1, 1, _unary_number(F.floor, "integer")),
    "CEIL": (1, 1, _unary_number(F.ceil, "integer")),
    "ROUND": (1, 1, _unary_number(lambda c: F.floor(c + 0.5), "integer")),
    "SQRT": (1, 1, lambda a: Typed(F.sqrt(to_number(a[0]).col), "float")),
    "IS_NULL": (1, 1, lambda a: Typed(F.lit(True) if a[0].kind == "null" else a[0].col.isNull(), "boolean")),
    "DATE_YEAR": (1, 1, lambda a: Typed(F.year(to_text(a[0]).try_cast("timestamp_ntz")).cast("bigint"), "integer")),
    "DATE_MONTH": (1, 1, lambda a: Typed(F.month(to_text(a[0]).try_cast("timestamp_ntz")).cast("bigint"), "integer")),
    "DATE_DAY": (1, 1, lambda a: Typed(F.dayofmonth(to_text(a[0]).try_cast("timestamp_ntz")).cast("bigint"), "integer")),
}


def _join(args: list[Typed]) -> Column:
    """Every argument, NULLs as empty text, with the separator between each two."""
    separator = _text_or_empty(args[0])
    out = F.lit("")
    for i, v in enumerate(args[1:]):
        out = F.concat(out, separator, _text_or_empty(v)) if i else _text_or_empty(v)
    return out


@dataclass(frozen=True)
class Expression:
    source: str
    tree: Node
    references: tuple[str, ...]

    def column(self, env: dict[str, Typed]) -> Typed:
        """The typed column for the typed columns of env; a column that env lacks is an error."""
        return _compile(self.tree, env)


def _compile(node: Node, env: dict[str, Typed]) -> Typed:
    if node.op == "literal":
        value = node.value
        if value is None:
            return Typed(F.lit(None), "null")
        if isinstance(value, bool):
            return Typed(F.lit(value), "boolean")
        if isinstance(value, int):
            return Typed(F.lit(value).cast("bigint"), "integer")
        return Typed(F.lit(value), "float" if isinstance(value, float) else "string")
    if node.op == "column":
        if node.value not in env:
            raise ExpressionError(f"unknown column @{node.value}")
        return env[node.value]
    parts = [_compile(p, env) for p in node.parts]
    if node.op == "not":
        return Typed(~truthy(parts[0]), "boolean")
    if node.op == "unary":
        v = to_number(parts[0])
        return Typed(F.negative(v.col), v.kind) if node.value == "-" else v
    if node.op == "if":
        kind = _joined_kind(parts[1:])
        return Typed(F.when(truthy(parts[0]), _as_kind(parts[1], kind)).otherwise(_as_kind(parts[2], kind)), kind)
    if node.op == "call":
        return FUNCTIONS[node.value][2](parts)
    a, b = parts
    if node.value == "&&":
        return Typed(truthy(a) & truthy(b), "boolean")
    if node.value == "||":
        return Typed(truthy(a) | truthy(b), "boolean")
    if node.value == "??":
        return _coalesce(parts)
    if node.value in ("==", "!="):
        same = _equal(a, b)
        return Typed(same if node.value == "==" else ~same, "boolean")
    if node.value in ("<", "<=", ">", ">="):
        return Typed(_compare(node.value, a, b), "boolean")
    return _arithmetic(node.value, a, b)


def _walk(node: Node):
    yield node
    for part in node.parts:
        yield from _walk(part)


def parse(text: str) -> Expression:
    """The expression of a text; unknown functions and wrong argument counts are errors here."""
    tree = _Parser(text).whole()
    names: dict[str, None] = {}
    for node in _walk(tree):
        if node.op == "column":
            names[node.value] = None
        if node.op == "call":
            if node.value not in FUNCTIONS:
                raise ExpressionError(f"unknown function {node.value}")
            least, most, _ = FUNCTIONS[node.value]
            if len(node.parts) < least or (most is not None and len(node.parts) > most):
                raise ExpressionError(f"{node.value} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(node.parts)}")
    return Expression(text, tree, tuple(names))


def preview(spark: SparkSession, text: str, row: dict[str, object]) -> dict[str, object]:
    """{references, result} of an expression over one row of plain values, or {references, error}."""
    try:
        expression = parse(text)
    except ExpressionError as error:
        return {"references": bind_names(text), "error": str(error)}
    kinds = {bool: ("boolean", "boolean"), int: ("bigint", "integer"), float: ("double", "float"), str: ("string", "string"), list: ("array<string>", "array")}
    given = {n: kinds.get(type(row.get(n)), ("string", "null")) for n in expression.references}
    frame = spark.range(1).select(F.lit(1).alias("__one"), *[F.lit(row.get(n)).cast(kind).alias(n) for n, (kind, _) in given.items()])
    try:
        value = expression.column({n: Typed(F.col(f"`{n}`"), logical) for n, (_, logical) in given.items()})
    except ExpressionError as error:
        return {"references": list(expression.references), "error": str(error)}
    return {"references": list(expression.references), "result": frame.select(value.col).first()[0]}


_BIND = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|@([A-Za-z_]\w*)""", re.S)


def bind_names(text: str) -> list[str]:
    """The @columns of a text outside quotes, in order, without repeats; the text may be of any
    dialect."""
    return list(dict.fromkeys(m[1] for m in _BIND.finditer(text) if m[1]))


def rewrite_binds(text: str, row: str = "row") -> str:
    """text with each @column outside quotes as a member of `row`."""
    return _BIND.sub(lambda m: f"{row}.`{m[1]}`" if m[1] else m[0], text)
