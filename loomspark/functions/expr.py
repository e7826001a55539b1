"""Conditions and expressions as text, translated to Spark columns.

The language is Python's expression syntax over column names, with `&&`, `||`, `AND`, `OR` (any case) as further spellings of
`and` and `or`, and `&`, `|` at the same low precedence. Only what is listed here is translated; all else is refused.

Missing values follow two-valued logic: a comparison with one is false, `!=` is true, and `not` turns that round. Where a
predicate stands in a positive place it stays a bare comparison, which Spark pushes to the scan; elsewhere it is made
two-valued by coalesce.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """The text isn't in the language, or names something that isn't there."""


_TOKEN = re.compile(
    r"""(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|`(?P<name>[^`]+)`|(?P<and>&&|&|\band\b)|(?P<or>\|\||\||\bor\b)|(?P<word>\w+)|(?P<rest>.)""",
    re.I | re.S | re.X,
)


def _rewrite(source: str) -> tuple[str, dict[str, str]]:
    """The text in plain Python syntax, and what its stand-ins for quoted column names mean."""
    out, names = [], {}
    for m in _TOKEN.finditer(source.strip()):
        if m["name"] is not None:
            alias = f"_quoted_{len(names)}"
            names[alias] = m["name"]
            out.append(alias)
        elif m["and"]:
            out.append(" and ")
        elif m["or"]:
            out.append(" or ")
        elif m["rest"] == "@":
            raise ExpressionError("local variables aren't part of the language")
        else:
            out.append(m[0])
    return "".join(out), names


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "num"
    if isinstance(dtype, T.StringType):
        return "str"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "struct" if isinstance(dtype, T.StructType) else "other"


def _real(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


#: Functions of one number by their names in the language.
_MATH = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "exp": F.exp, "expm1": F.expm1, "log": F.log,
    "log10": F.log10, "log1p": F.log1p, "sqrt": F.sqrt,
}
_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "dayofweek": F.weekday, "quarter": F.quarter, "date": F.to_date, "dayofyear": F.dayofyear,
}
_ORDER = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


class _Translator:
    def __init__(self, schema: T.StructType, names: dict[str, str]) -> None:
        self.schema, self.names = schema, names

    # values: (column, kind)

    def value(self, node: ast.expr) -> tuple[Column, str]:
        if isinstance(node, (ast.BoolOp, ast.Compare)) or (isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert))):
            return self.test(node, False), "bool"
        make = getattr(self, f"_{type(node).__name__.lower()}", None)
        if make is None:
            raise ExpressionError(f"{type(node).__name__} isn't part of the language")
        return make(node)

    def _constant(self, node: ast.Constant) -> tuple[Column, str]:
        v = node.value
        if v is None or isinstance(v, (bool, int, float, str)):
            return F.lit(v), "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"
        raise ExpressionError(f"a literal of type {type(v).__name__}")

    def _name(self, node: ast.Name) -> tuple[Column, str]:
        name = self.names.get(node.id, node.id)
        if name not in self.schema.fieldNames():
            raise ExpressionError(f"no column named {name!r}")
        return F.col(f"`{name}`"), _kind(self.schema[name].dataType)

    def _attribute(self, node: ast.Attribute) -> tuple[Column, str]:
        if node.attr.startswith("_"):
            raise ExpressionError(f"attribute {node.attr!r}")
        if isinstance(node.value, ast.Attribute) and node.value.attr == "dt":
            if node.attr not in _PARTS:
                raise ExpressionError(f"unknown part of a time: {node.attr}")
            c, kind = self.value(node.value.value)
            c = F.to_timestamp(c) if kind == "str" else c
            return _PARTS[node.attr](c), "time" if node.attr == "date" else "num"
        path: list[str] = []
        at: ast.expr = node
        while isinstance(at, ast.Attribute):
            path.insert(0, at.attr)
            at = at.value
        if not isinstance(at, ast.Name):
            raise ExpressionError("an attribute of something that isn't a column")
        column, _ = self._name(at)
        dtype = self.schema[self.names.get(at.id, at.id)].dataType
        for p in path:
            if not isinstance(dtype, T.StructType) or p not in dtype.fieldNames():
                raise ExpressionError(f"no field {p!r}")
            column, dtype = column.getField(p), dtype[p].dataType
        return column, _kind(dtype)

    def _unaryop(self, node: ast.UnaryOp) -> tuple[Column, str]:
        c, kind = self.value(node.operand)
        return (-c if isinstance(node.op, ast.USub) else c), kind

    def _binop(self, node: ast.BinOp) -> tuple[Column, str]:
        (a, ka), (b, kb) = self.value(node.left), self.value(node.right)
        op = type(node.op)
        if op is ast.Add and "str" in (ka, kb):
            if ka != kb:
                raise ExpressionError("text and numbers don't add up; convert first")
            return F.concat(a, b), "str"
        if op in (ast.BitAnd, ast.BitOr):
            return self.test(ast.BoolOp(ast.And() if op is ast.BitAnd else ast.Or(), [node.left, node.right]), False), "bool"
        floor = F.floor(F.try_divide(a, b))
        made = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.FloorDiv: lambda: floor, ast.Mod: lambda: a - b * floor, ast.Pow: lambda: F.pow(a, b)}
        if op not in made:
            raise ExpressionError(f"operator {op.__name__}")
        return made[op](), "num" if ka != "time" else "time"

    def _ifexp(self, node: ast.IfExp) -> tuple[Column, str]:
        (a, kind), (b, _) = self.value(node.body), self.value(node.orelse)
        return F.when(self.test(node.test, False), a).otherwise(b), kind

    def _call(self, node: ast.Call) -> tuple[Column, str]:
        if node.keywords and any(k.arg not in ("regex", "case", "na") for k in node.keywords):
            raise ExpressionError("named arguments")
        args = node.args
        if isinstance(node.func, ast.Name):
            return self._function(node.func.id, [self.value(a)[0] for a in args])
        if not isinstance(node.func, ast.Attribute):
            raise ExpressionError("a call of something that isn't a function")
        of, method = node.func.value, node.func.attr
        if isinstance(of, ast.Attribute) and of.attr == "str":
            options = {k.arg: self._plain(k.value) for k in node.keywords}
            return self._text_method(self.value(of.value)[0], method, [self._plain(a) for a in args], options)
        return self._method(of, method, args)

    def _function(self, name: str, args: list[Column]) -> tuple[Column, str]:
        if name in _MATH and len(args) == 1:
            return _real(_MATH[name](args[0].cast("double"))), "num"
        one = {"abs": F.abs, "floor": F.floor, "ceil": F.ceil}
        if name in one and len(args) == 1:
            return one[name](args[0]), "num"
        if name == "arctan2" and len(args) == 2:
            return F.atan2(*args), "num"
        raise ExpressionError(f"unknown function {name!r}")

    def _plain(self, node: ast.expr) -> object:
        try:
            return ast.literal_eval(node)
        except ValueError as e:
            raise ExpressionError("this argument has to be a literal") from e

    def _text_method(self, c: Column, method: str, args: list, options: dict) -> tuple[Column, str]:
        if method == "contains":
            if options.get("regex", True):
                return F.coalesce(c.rlike(args[0] if options.get("case", True) else f"(?i){args[0]}"), F.lit(False)), "bool"
            return F.coalesce(c.contains(args[0]), F.lit(False)), "bool"
        if method in ("startswith", "endswith"):
            return F.coalesce(getattr(c, method)(args[0]), F.lit(False)), "bool"
        if method in ("lower", "upper", "strip", "title") and not args:
            return {"lower": F.lower, "upper": F.upper, "strip": lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""), "title": F.initcap}[method](c), "str"
        if method == "len":
            return F.length(c), "num"
        if method == "slice":
            lo, hi = (list(args) + [None, None])[:2]
            lo = lo or 0
            if lo < 0 or (hi is not None and hi < 0):
                raise ExpressionError("slices count from the start")
            return F.substring(c, lo + 1, F.lit(2**31 - 1) if hi is None else F.lit(max(0, hi - lo))), "str"
        if method == "replace":
            return (F.regexp_replace(c, F.lit(args[0]), F.lit(args[1])) if options.get("regex", False) else F.replace(c, F.lit(args[0]), F.lit(args[1]))), "str"
        raise ExpressionError(f"unknown text method {method!r}")

    def _method(self, of: ast.expr, method: str, args: list[ast.expr]) -> tuple[Column, str]:
        if method in ("isnull", "isna", "notnull", "notna", "isin", "between"):
            return self.test(ast.Call(ast.Attribute(of, method), args, []), False), "bool"
        c, kind = self.value(of)
        if method == "abs":
            return F.abs(c), "num"
        if method == "round":
            return F.bround(c, self._plain(args[0]) if args else 0), "num"
        if method == "fillna":
            return F.coalesce(c, self.value(args[0])[0]), kind
        if method == "clip":
            lo, hi = ([self.value(a)[0] for a in args] + [None, None])[:2]
            out = c if lo is None else F.greatest(c, lo)
            return F.when(c.isNotNull(), out if hi is None else F.least(out, hi)), "num"
        if method == "astype":
            name = self._plain(args[0]) if isinstance(args[0], ast.Constant) else args[0].id if isinstance(args[0], ast.Name) else None
            if name not in CONVERSIONS:
                raise ExpressionError(f"unknown type {name!r}")
            return convert(c, kind, name), {"int": "num", "float": "num", "str": "str", "string": "str", "bool": "bool"}.get(name, "time")
        raise ExpressionError(f"unknown method {method!r}")

    # predicates: true or false, or null for false in a positive place

    def test(self, node: ast.expr, positive: bool) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.test(v, positive) for v in node.values]
            return reduce(lambda a, b: a & b if isinstance(node.op, ast.And) else a | b, parts)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~self.test(node.operand, False)
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            parts = [self._compare(a, op, b, positive) for a, op, b in zip(sides, node.ops, sides[1:], strict=False)]
            return reduce(lambda a, b: a & b, parts)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            method, of = node.func.attr, node.func.value
            if method in ("isnull", "isna"):
                return self.value(of)[0].isNull()
            if method in ("notnull", "notna"):
                return self.value(of)[0].isNotNull()
            if method == "isin":
                return self._among(of, self._plain(node.args[0]), positive)
            if method == "between":
                lo, hi = (self.value(a)[0] for a in node.args[:2])
                return self._two(self.value(of)[0].between(lo, hi), positive)
        c, kind = self.value(node)
        if kind != "bool":
            raise ExpressionError("this isn't a condition")
        return c if positive else F.coalesce(c, F.lit(False))

    @staticmethod
    def _two(c: Column, positive: bool) -> Column:
        return c if positive else F.coalesce(c, F.lit(False))

    def _among(self, of: ast.expr, values: object, positive: bool) -> Column:
        if not isinstance(values, (list, tuple, set)):
            raise ExpressionError("`in` needs a list")
        c, real = self.value(of)[0], [v for v in values if v is not None]
        found = c.isin(real) if real else F.lit(False)
        return self._two(found, positive) if len(real) == len(values) else F.coalesce(found, F.lit(False)) | c.isNull()

    def _compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr, positive: bool) -> Column:
        listed = isinstance(right, (ast.List, ast.Tuple, ast.Set))
        if isinstance(op, (ast.In, ast.NotIn)) or (listed and isinstance(op, (ast.Eq, ast.NotEq))):
            found = self._among(left, self._plain(right), positive and isinstance(op, (ast.In, ast.Eq)))
            return found if isinstance(op, (ast.In, ast.Eq)) else ~found
        a, b = self.value(left)[0], self.value(right)[0]
        if isinstance(op, ast.Eq):
            return self._two(a == b, positive)
        if isinstance(op, ast.NotEq):
            literal = isinstance(left, ast.Constant) or isinstance(right, ast.Constant)
            return ~a.eqNullSafe(b) if literal else F.coalesce(a != b, F.lit(True))
        if type(op) in _ORDER:
            return self._two(getattr(a, _ORDER[type(op)])(b), positive)
        raise ExpressionError(f"comparison {type(op).__name__}")


#: Type names of the language and the types of Spark that they convert to.
CONVERSIONS = {
    "int": "bigint", "int64": "bigint", "Int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float",
    "str": "string", "string": "string", "bool": "boolean", "datetime": "timestamp", "datetime64": "timestamp", "datetime64[ns]": "timestamp",
}


def convert(c: Column, kind: str, target: str) -> Column:
    """`c` as the target type. Missing stays missing but for bool, where it is true as any text but the empty one is."""
    if target not in CONVERSIONS:
        raise ExpressionError(f"unknown type {target!r}")
    if target == "bool":
        return F.coalesce(F.length(c) > 0 if kind == "str" else c.cast("boolean") if kind in ("num", "bool") else c.isNotNull(), F.lit(True))
    return c.cast(CONVERSIONS[target])


def kind_of(df: DataFrame, column: str) -> str:
    return _kind(df.schema[column].dataType)


def _parse(source: str) -> tuple[ast.expr, dict[str, str]]:
    text, names = _rewrite(source)
    try:
        return ast.parse(text.strip(), mode="eval").body, names
    except SyntaxError as e:
        raise ExpressionError(f"can't read {source!r}: {e.msg}") from e


def condition(df: DataFrame, source: str) -> Column:
    """A predicate for filter(): null counts as false."""
    tree, names = _parse(source)
    return _Translator(df.schema, names).test(tree, True)


def two_valued(df: DataFrame, source: str) -> Column:
    """A predicate that is never null."""
    tree, names = _parse(source)
    return F.coalesce(_Translator(df.schema, names).test(tree, False), F.lit(False))


def expression(df: DataFrame, source: str) -> Column:
    """A computed value."""
    tree, names = _parse(source)
    return _Translator(df.schema, names).value(tree)[0]


def tree(source: str) -> tuple[ast.expr, dict[str, str]]:
    """The text's syntax tree, and the columns that its stand-ins for quoted names mean, for those who translate it otherwise."""
    return _parse(source)


def columns_used(source: str) -> list[str]:
    """The names that an expression reads, in order; what they are is the caller's to know."""
    tree, names = _parse(source)
    calls = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    found = [names.get(n.id, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id not in calls]
    return list(dict.fromkeys(found))
