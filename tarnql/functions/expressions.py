"""Python row expressions as Spark columns.

An expression is parsed, never evaluated, and every node of it is lowered with the meaning Python gives it: floor division and
modulo that follow the divisor's sign, true division, chained comparisons, truth of numbers and strings, and operands that are
only evaluated if they are reached. Integers are computed in 64 bits. What has no counterpart is an error when the plan is built.
"""

from __future__ import annotations

import ast
import builtins
import datetime
import math
import types
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import Schema, day_number


class ExpressionError(ValueError):
    """An expression that cannot be lowered."""


@dataclass
class Value:
    """A lowered expression: its column, its kind (int, float, str, bool, list), a constant's value, whether evaluating it
    can fail on some rows, and for days the date column behind the number."""

    column: Column | None
    kind: str
    constant: object = None
    risky: bool = False
    day: Column | None = None
    items: list | None = None
    parts: Column | None = None


def attributes(expression: str) -> set[str]:
    """Names of the columns an expression uses; names that are called or lead an attribute (math.pi) are not columns."""
    tree = ast.parse(expression.strip(), mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    called |= {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "math"}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def conjuncts(expression: str) -> list[str]:
    """The operands of the top-level and, which are all that must hold."""

    def split(n):
        return [x for v in n.values for x in split(v)] if isinstance(n, ast.BoolOp) and isinstance(n.op, ast.And) else [ast.unparse(n)]

    return split(ast.parse(expression.strip(), mode="eval").body)


def separable(expression: str, env: Mapping[str, Value], before: Sequence[str] = ()) -> list[str]:
    """The conjuncts of an expression such that each may be applied on its own, in any order and place.

    A conjunct that can fail on some rows is kept together with all that come before it, those of before first, so that it is still only evaluated
    where they hold. The operands True are left out.
    """
    out, guard = [], list(before)
    for part in conjuncts(expression):
        if part == "True":
            continue
        risky = guard and compile_expression(part, env).risky
        out.append(" and ".join(f"({x})" for x in [*guard, part]) if risky else part)
        guard.append(part)
    return out


def is_attribute(expression: str) -> bool:
    return isinstance(ast.parse(expression.strip(), mode="eval").body, ast.Name)


def column_of(name: str, kind: str) -> Value:
    c = F.col(f"`{name}`")
    return Value(day_number(c).cast("long"), "int", day=c) if kind == "date" else Value(c.cast("long") if kind == "int" else c, kind)


def environment(schema: Schema) -> dict[str, Value]:
    return {f: column_of(f, t.kind) for f, t in zip(schema.fields, schema.types)}


def compile_expression(expression: str | ast.AST, env: Mapping[str, Value]) -> Value:
    """Lowers an expression over the names in env."""
    if isinstance(expression, str):
        try:
            expression = ast.parse(expression.strip(), mode="eval").body
        except SyntaxError as e:
            raise ExpressionError(f"not an expression: {expression!r}") from e
    return _Lowering(env).value(expression)


def compile_predicate(expression: str, env: Mapping[str, Value]) -> Column:
    """Lowers an expression to its truth."""
    return truth(compile_expression(expression, env))


def truth(v: Value) -> Column:
    if v.kind == "bool":
        return v.column
    if v.kind in ("int", "float"):
        return v.column != 0
    if v.kind == "str":
        return v.column != ""
    raise ExpressionError("a list has no truth here")


def _number(v: Value) -> Value:
    if v.kind == "bool":
        return Value(v.column.cast("long"), "int", None if v.constant is None else int(v.constant), v.risky)
    if v.kind not in ("int", "float"):
        raise ExpressionError(f"a number is needed, not a {v.kind}")
    return v


def _double(v: Value) -> Column:
    return v.column.cast("double")


def _floor_mod(a: Column, b: Column) -> Column:
    m = a % b
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_MATH = {"sqrt": "sqrt", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "log2": "log2", "log10": "log10", "log1p": "log1p", "expm1": "expm1", "degrees": "degrees", "radians": "radians", "fabs": "abs", "cbrt": "cbrt"}
_TESTS = {"isdigit": r"\A\p{Nd}+\z", "isalpha": r"\A\p{L}+\z", "isalnum": r"\A[\p{L}\p{Nd}]+\z", "isspace": r"\A\s+\z"}


class _Lowering:
    def __init__(self, env: Mapping[str, Value]):
        self.env = env

    def value(self, n: ast.AST) -> Value:
        lower = getattr(self, f"_{type(n).__name__}", None)
        if lower is None:
            raise ExpressionError(f"{type(n).__name__} is not supported: {ast.unparse(n)}")
        return lower(n)

    def _Constant(self, n):
        x = n.value
        if isinstance(x, bool):
            return Value(F.lit(x), "bool", x)
        if isinstance(x, int):
            if not -(1 << 63) <= x < 1 << 63:
                return Value(F.lit(float(x)), "float", x)
            return Value(F.lit(x).cast("long"), "int", x)
        if isinstance(x, float):
            return Value(F.lit(x), "float", x)
        if isinstance(x, str):
            return Value(F.lit(x), "str", x)
        if x is None:
            return Value(F.lit(None), "none")
        raise ExpressionError(f"no such constant: {x!r}")

    def _Name(self, n):
        if n.id not in self.env:
            raise ExpressionError(f"no column {n.id!r}; there are {sorted(self.env)}")
        return self.env[n.id]

    def _items(self, n):
        return Value(None, "list", items=[self.value(x) for x in n.elts])

    _Tuple = _List = _Set = _items

    def _BinOp(self, n):
        a, b, op = self.value(n.left), self.value(n.right), type(n.op)
        risky = a.risky or b.risky
        if op is ast.Add and a.kind == b.kind == "str":
            return Value(F.concat(a.column, b.column), "str", risky=risky)
        if op is ast.Mult and {a.kind, b.kind} == {"str", "int"}:
            text, times = (a, b) if a.kind == "str" else (b, a)
            return Value(F.call_function("repeat", text.column, times.column.cast("int")), "str", risky=risky)
        a, b = _number(a), _number(b)
        both = a.kind == b.kind == "int"
        kind = "int" if both else "float"
        x, y = (a.column, b.column) if both else (_double(a), _double(b))
        risky = risky or not b.constant and op in (ast.Div, ast.FloorDiv, ast.Mod)
        if op in _BINARY:
            known = {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q}[_BINARY[op]]
            return Value(known(x, y), kind, known(a.constant, b.constant) if a.constant is not None and b.constant is not None else None, risky)
        if op is ast.Div:
            return Value(_double(a) / _double(b), "float", risky=risky)
        if op is ast.Mod:
            return Value(_floor_mod(x, y), kind, risky=risky)
        if op is ast.FloorDiv:
            whole = F.call_function("div", x - _floor_mod(x, y), y) if both else F.rint((x - _floor_mod(x, y)) / y)
            return Value(whole, kind, risky=risky)
        if op is ast.Pow:
            if both and isinstance(b.constant, int) and 0 <= b.constant <= 64:
                return Value(self._power(x, b.constant), "int", risky=risky)
            return Value(F.pow(_double(a), _double(b)), "float", risky=risky)
        if not both:
            raise ExpressionError(f"{ast.unparse(n)} needs integers")
        if op in (ast.LShift, ast.RShift):
            return Value(F.call_function("shiftleft" if op is ast.LShift else "shiftright", x, y.cast("int")), "int", risky=risky)
        known = {ast.BitAnd: x.bitwiseAND, ast.BitOr: x.bitwiseOR, ast.BitXor: x.bitwiseXOR}.get(op)
        if known is None:
            raise ExpressionError(f"not supported: {ast.unparse(n)}")
        return Value(known(y), "int", risky=risky)

    @staticmethod
    def _power(x: Column, n: int) -> Column:
        out = F.lit(1).cast("long")
        for bit in bin(n)[2:]:
            out = out * out * x if bit == "1" else out * out
        return out

    def _UnaryOp(self, n):
        v = self.value(n.operand)
        if isinstance(n.op, ast.Not):
            return Value(~truth(v), "bool", risky=v.risky)
        v = _number(v)
        if isinstance(n.op, ast.USub):
            return Value(-v.column, v.kind, None if v.constant is None else -v.constant, v.risky)
        if isinstance(n.op, ast.Invert):
            if v.kind != "int":
                raise ExpressionError("~ needs an integer")
            return Value(F.bitwise_not(v.column), "int", risky=v.risky)
        return v

    def _BoolOp(self, n):
        """The truth of and / or. An operand that can fail is only evaluated where those before it leave the outcome open."""
        values = [self.value(x) for x in n.values]
        out = truth(values[-1])
        for v, nxt in zip(values[-2::-1], values[:0:-1]):
            t = truth(v)
            if isinstance(n.op, ast.And):
                out = F.when(t, out).otherwise(False) if nxt.risky else t & out
            else:
                out = F.when(t, True).otherwise(out) if nxt.risky else t | out
            nxt.risky = nxt.risky or v.risky
        return Value(out, "bool", risky=any(v.risky for v in values))

    def _Compare(self, n):
        values = [self.value(x) for x in (n.left, *n.comparators)]
        out = None
        for op, a, b in zip(n.ops, values, values[1:]):
            one = self._compared(op, a, b, n)
            out = one if out is None else out & one
        return Value(out, "bool", risky=any(v.risky for v in values))

    def _compared(self, op, a: Value, b: Value, n) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if "none" not in (a.kind, b.kind):
                raise ExpressionError("is can only be used with None")
            return F.lit(isinstance(op, ast.IsNot) != (a.kind == b.kind))
        if isinstance(op, (ast.In, ast.NotIn)):
            if b.kind == "list":
                if b.items and a.constant is None and all(x.constant is not None and x.kind == a.kind for x in b.items):
                    found = a.column.isin([x.constant for x in b.items])
                else:
                    found = F.lit(False)
                    for x in b.items:
                        found = found | self._compared(ast.Eq(), a, x, n)
            elif a.kind == b.kind == "str":
                found = F.contains(b.column, a.column)
            else:
                raise ExpressionError(f"not supported: {ast.unparse(n)}")
            return ~found if isinstance(op, ast.NotIn) else found
        sign = _COMPARE[type(op)]
        numbers = [v.kind in ("int", "float", "bool") for v in (a, b)]
        if not (all(numbers) or a.kind == b.kind == "str"):
            if sign in ("==", "!="):
                return F.lit(sign == "!=")
            raise ExpressionError(f"{a.kind} and {b.kind} have no order: {ast.unparse(n)}")
        days = self._days(sign, a, b)
        if days is not None:
            return days
        x, y = (a.column, b.column) if a.kind == b.kind else (_number(a).column, _number(b).column)
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]

    @staticmethod
    def _days(sign: str, a: Value, b: Value) -> Column | None:
        """A day and a number are compared as times against the bounds of the number's day, which reach the scan."""
        if a.day is None and b.day is not None:
            a, b, sign = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(sign, sign)
        if a.day is None or not isinstance(b.constant, int):
            return None
        try:
            day = datetime.date(b.constant // 10000, b.constant // 100 % 100, b.constant % 100)
            begin, end = F.lit(day), F.lit(day + datetime.timedelta(1))
        except (ValueError, OverflowError):
            return None  # no day has this number: compared as numbers
        return {"<": a.day < begin, ">=": a.day >= begin, "<=": a.day < end, ">": a.day >= end, "==": (a.day >= begin) & (a.day < end), "!=": (a.day < begin) | (a.day >= end)}[sign]

    def _IfExp(self, n):
        test, a, b = self.value(n.test), self.value(n.body), self.value(n.orelse)
        if a.kind != b.kind:
            a, b = _number(a), _number(b)
        kind = a.kind if a.kind == b.kind else "float"
        x, y = (a.column, b.column) if a.kind == b.kind else (_double(a), _double(b))
        return Value(F.when(truth(test), x).otherwise(y), kind, risky=test.risky or a.risky or b.risky)

    def _Attribute(self, n):
        if isinstance(n.value, ast.Name) and n.value.id == "math" and n.attr in ("pi", "e", "tau"):
            return Value(F.lit(getattr(math, n.attr)), "float", getattr(math, n.attr))
        raise ExpressionError(f"not supported: {ast.unparse(n)}")

    def _Subscript(self, n):
        v, s = self.value(n.value), n.slice
        if v.parts is not None:
            i = self._constant(s)
            return Value(F.element_at(v.parts, i + 1 if i >= 0 else i), "str", risky=True)
        if v.kind == "list":
            return v.items[self._constant(s)]
        if v.kind != "str":
            raise ExpressionError(f"only strings have parts: {ast.unparse(n)}")
        size = F.char_length(v.column)
        at = lambda i: F.lit(i) if i >= 0 else F.greatest(size + F.lit(i), F.lit(0))
        if isinstance(s, ast.Slice):
            if s.step is not None:
                raise ExpressionError("slices with steps are not supported")
            a = at(self._constant(s.lower)) if s.lower else F.lit(0)
            b = at(self._constant(s.upper)) if s.upper else size
            return Value(F.substring(v.column, a + 1, F.greatest(b - a, F.lit(0))), "str", risky=v.risky)
        i = self._constant(s)
        start = F.lit(i + 1) if i >= 0 else size + F.lit(i + 1)
        return Value(F.when((start >= 1) & (start <= size), F.substring(v.column, start, F.lit(1))).otherwise(F.raise_error(F.lit("string index out of range")).cast("string")), "str", risky=True)

    def _constant(self, n):
        c = self.value(n).constant
        if not isinstance(c, int):
            raise ExpressionError(f"a constant is needed: {ast.unparse(n)}")
        return c

    def _Call(self, n):
        if n.keywords:
            raise ExpressionError(f"named arguments are not supported: {ast.unparse(n)}")
        if isinstance(n.func, ast.Attribute):
            if isinstance(n.func.value, ast.Name) and n.func.value.id == "math":
                return self._math(n.func.attr, [self.value(a) for a in n.args], n)
            return self._method(self.value(n.func.value), n.func.attr, [self.value(a) for a in n.args], n)
        known = getattr(self, f"_call_{n.func.id}", None) if isinstance(n.func, ast.Name) else None
        if known is None:
            raise ExpressionError(f"no function {ast.unparse(n.func)}")
        args = [self.value(a) for a in n.args]
        out = known(*args)
        out.risky = out.risky or any(a.risky for a in args)
        return out

    def _math(self, name, args, n):
        risky, args = any(a.risky for a in args), [_number(a) for a in args]
        if name in _MATH and len(args) == 1:
            return Value(getattr(F, _MATH[name])(_double(args[0])), "float", risky=risky)
        if name == "log":
            return Value(F.log(_double(args[0])) / F.log(_double(args[1])) if len(args) == 2 else F.log(_double(args[0])), "float", risky=risky)
        if name in ("floor", "ceil", "trunc"):
            x = args[0]
            f = {"floor": F.floor, "ceil": F.ceil, "trunc": lambda c: c}[name]
            return Value(f(x.column).cast("long"), "int", risky=risky)
        if name in ("pow", "atan2", "hypot"):
            return Value(getattr(F, name)(_double(args[0]), _double(args[1])), "float", risky=risky)
        raise ExpressionError(f"not supported: {ast.unparse(n)}")

    def _method(self, v, name, args, n):
        risky = v.risky or any(a.risky for a in args)
        if v.kind != "str" or any(a.kind not in ("str", "int") for a in args):
            raise ExpressionError(f"not supported: {ast.unparse(n)}")
        s, a = v.column, [x.column for x in args]
        if name in ("upper", "lower") and not a:
            return Value(getattr(F, name)(s), "str", risky=risky)
        if name in ("strip", "lstrip", "rstrip"):
            if a:
                return Value({"strip": F.btrim, "lstrip": lambda x, y: F.call_function("ltrim", y, x), "rstrip": lambda x, y: F.call_function("rtrim", y, x)}[name](s, a[0]), "str", risky=risky)
            pattern = {"strip": r"\A\s+|\s+\z", "lstrip": r"\A\s+", "rstrip": r"\s+\z"}[name]
            return Value(F.regexp_replace(s, pattern, ""), "str", risky=risky)
        if name in ("startswith", "endswith") and len(a) == 1:
            return Value(getattr(F, name)(s, a[0]), "bool", risky=risky)
        if name == "replace" and len(a) == 2 and args[0].constant != "":
            return Value(F.replace(s, a[0], a[1]), "str", risky=risky)
        if name == "find" and len(a) == 1:
            return Value((F.call_function("locate", a[0], s) - 1).cast("long"), "int", risky=risky)
        if name == "count" and len(a) == 1 and args[0].constant:
            return Value(F.call_function("div", (F.char_length(s) - F.char_length(F.replace(s, a[0], F.lit("")))).cast("long"), F.char_length(a[0]).cast("long")), "int", risky=risky)
        if name == "split" and len(a) <= 1:
            if a and not isinstance(args[0].constant, str):
                raise ExpressionError("split needs a constant")
            quoted = "".join(c if c.isalnum() else "\\" + c for c in args[0].constant) if a else r"\s+"
            parts = F.split(s if a else F.regexp_replace(s, r"\A\s+|\s+\z", ""), quoted, -1)
            return Value(None, "list", risky=True, parts=parts)
        if name in _TESTS and not a:
            return Value(F.regexp_like(s, F.lit(_TESTS[name])), "bool", risky=risky)
        raise ExpressionError(f"not supported: {ast.unparse(n)}")

    def _extreme(self, args, f):
        args = args[0].items if len(args) == 1 and args[0].kind == "list" else list(args)
        if all(a.kind == "str" for a in args):
            return Value(f(*[a.column for a in args]) if len(args) > 1 else args[0].column, "str")
        args = [_number(a) for a in args]
        kind = "int" if all(a.kind == "int" for a in args) else "float"
        columns = [a.column if kind == "int" else _double(a) for a in args]
        return Value(f(*columns) if len(columns) > 1 else columns[0], kind)

    def _call_min(self, *args):
        return self._extreme(args, F.least)

    def _call_max(self, *args):
        return self._extreme(args, F.greatest)

    def _call_abs(self, x):
        x = _number(x)
        return Value(F.abs(x.column), x.kind)

    def _call_len(self, x):
        if x.parts is not None:
            return Value(F.size(x.parts).cast("long"), "int")
        if x.kind == "list":
            return Value(F.lit(len(x.items)).cast("long"), "int", len(x.items))
        return Value(F.char_length(x.column).cast("long"), "int")

    def _call_round(self, x, digits=None):
        x = _number(x)
        if digits is None:
            return Value(x.column if x.kind == "int" else F.bround(x.column, 0).cast("long"), "int")
        if not isinstance(digits.constant, int):
            raise ExpressionError("round needs a constant number of digits")
        return Value(F.bround(x.column, digits.constant), x.kind)

    def _call_int(self, x):
        if x.kind == "str":
            return Value(F.regexp_replace(x.column, r"\A\s+|\s+\z", "").cast("long"), "int", risky=True)
        return Value(_number(x).column.cast("long"), "int", risky=x.kind == "float")

    def _call_float(self, x):
        return Value(x.column.cast("double"), "float", risky=x.kind == "str")

    def _call_str(self, x):
        return Value(F.when(x.column, "True").otherwise("False") if x.kind == "bool" else x.column.cast("string"), "str")

    def _call_bool(self, x):
        return Value(truth(x), "bool")

    def _call_pow(self, a, b):
        return self._BinOp(ast.BinOp(Lowered(a), ast.Pow(), Lowered(b)))

    def _call_sum(self, x):
        if x.kind != "list" or not x.items:
            raise ExpressionError("sum needs a list of values")
        out = Lowered(x.items[0])
        for item in x.items[1:]:
            out = ast.BinOp(out, ast.Add(), Lowered(item))
        return self.value(out)

    def _Lowered(self, n):
        return n.known


class Lowered(ast.AST):
    """A node that is lowered already."""

    def __init__(self, known: Value):
        self.known = known


class Untraceable(Exception):
    """A function whose result depends on the truth of a column, or that uses something without a counterpart."""


class Traced:
    """Stands for a row's value while a function runs, and records as a syntax tree what is done with it."""

    def __init__(self, node: ast.AST):
        self.node = node

    def __bool__(self):
        raise Untraceable("the function branches on a value")

    def __iter__(self):
        raise Untraceable("the function iterates over a value")

    __hash__ = None

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return _Method(self, name)

    def __getitem__(self, i):
        return Traced(ast.Subscript(self.node, _slice(i), ast.Load()))


def _slice(i):
    return ast.Slice(*(None if x is None else _node(x) for x in (i.start, i.stop, i.step))) if isinstance(i, slice) else _node(i)


class _Method:
    def __init__(self, of: Traced, name: str):
        self.of, self.name = of, name

    def __call__(self, *args):
        return Traced(ast.Call(ast.Attribute(self.of.node, self.name, ast.Load()), [_node(a) for a in args], []))


class TracedRow:
    """Stands for a row: attributes and items are its fields."""

    def __init__(self, fields):
        self._fields = list(fields)

    def __getattr__(self, name):
        if name not in self._fields:
            raise AttributeError(f"no column {name!r}")
        return Traced(ast.Name(name, ast.Load()))

    def __getitem__(self, i):
        return getattr(self, self._fields[i])


def _node(x) -> ast.AST:
    if isinstance(x, Traced):
        return x.node
    if isinstance(x, (tuple, list)):
        return ast.Tuple([_node(v) for v in x], ast.Load())
    if isinstance(x, (bool, int, float, str)):
        return ast.Constant(x)
    raise Untraceable(f"no counterpart for {x!r}")


def _operator(op, swapped=False):
    return lambda self, other: Traced(ast.BinOp(*((_node(other), op(), self.node) if swapped else (self.node, op(), _node(other)))))


for _name, _op in {"add": ast.Add, "sub": ast.Sub, "mul": ast.Mult, "truediv": ast.Div, "floordiv": ast.FloorDiv, "mod": ast.Mod, "pow": ast.Pow, "and": ast.BitAnd, "or": ast.BitOr, "xor": ast.BitXor, "lshift": ast.LShift, "rshift": ast.RShift}.items():
    setattr(Traced, f"__{_name}__", _operator(_op))
    setattr(Traced, f"__r{_name}__", _operator(_op, True))
for _name, _op in {"eq": ast.Eq, "ne": ast.NotEq, "lt": ast.Lt, "le": ast.LtE, "gt": ast.Gt, "ge": ast.GtE}.items():
    setattr(Traced, f"__{_name}__", (lambda op: lambda self, other: Traced(ast.Compare(self.node, [op()], [_node(other)])))(_op))
for _name, _op in {"neg": ast.USub, "pos": ast.UAdd, "invert": ast.Invert}.items():
    setattr(Traced, f"__{_name}__", (lambda op: lambda self: Traced(ast.UnaryOp(op(), self.node)))(_op))
setattr(Traced, "__abs__", lambda self: Traced(ast.Call(ast.Name("abs", ast.Load()), [self.node], [])))
setattr(Traced, "__round__", lambda self, n=None: Traced(ast.Call(ast.Name("round", ast.Load()), [self.node] + ([] if n is None else [_node(n)]), [])))


def _recorded(name: str):
    plain = getattr(builtins, name)

    def call(*args):
        flat = list(args[0]) if len(args) == 1 and isinstance(args[0], (tuple, list)) else args
        if not any(isinstance(a, Traced) for a in flat):
            return plain(*args)
        return Traced(ast.Call(ast.Name(name, ast.Load()), [_node(a) for a in args], []))

    return call


_RECORDED = {name: _recorded(name) for name in ("min", "max", "len", "int", "float", "str", "sum", "pow", "bool")}


class _RecordedMath:
    def __getattr__(self, name):
        plain = getattr(math, name)
        if not callable(plain):
            return plain
        return lambda *args: Traced(ast.Call(ast.Attribute(ast.Name("math", ast.Load()), name, ast.Load()), [_node(a) for a in args], [])) if any(isinstance(a, Traced) for a in args) else plain(*args)


def trace(function: Callable, *args):
    """What a function makes of traced arguments: a Traced, a constant, or a tuple of them. Raises Untraceable."""
    for name, recorded in _RECORDED.items():
        if function is getattr(builtins, name):
            function = recorded
    if isinstance(function, types.FunctionType):
        names = {**function.__globals__, **{k: v for k, v in _RECORDED.items() if function.__globals__.get(k, getattr(builtins, k)) is getattr(builtins, k)}}
        names |= {k: _RecordedMath() for k, v in function.__globals__.items() if v is math}
        function = types.FunctionType(function.__code__, names, function.__name__, function.__defaults__, function.__closure__)
    try:
        out = function(*args)
        _ = [_node(x) for x in (out if isinstance(out, tuple) else (out,))]
        return out
    except Untraceable:
        raise
    except Exception as e:
        raise Untraceable(str(e)) from e


def traced_node(x) -> ast.AST:
    return _node(x)
