"""Inner joins. The four methods differ in what they are given, not in their result; Spark picks the physical join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.expressions import attributes, column_of, compile_predicate, environment, separable
from ..functions.types import Schema
from .base import Operator
from .scan import TableScan

METHODS = ("nested-loops", "block-nested-loops", "indexed", "hash")
BLOCK_PAGES = 32768  # pages of 4 KiB in the default buffer of 128 MiB, for the cost of block-nested-loops


class Join(Operator):
    """Pairs of rows of both inputs that meet an expression, have equal keys, or both; fields of the left, then of the right.

    left_schema and right_schema name an input's fields anew by position. hash takes key schemas (compared by position, under
    the fields' names in the two inputs) and hash functions, which only place rows and are checked but not used; indexed takes the left key's
    schema and an index of the right input, a scan. All matches are found by either. Days are equal as days, whatever the time of day
    behind them. With expr "True" a join is a cross product. An operand of and that can fail is only evaluated for pairs that
    meet the keys and the operands before it, wherever Catalyst evaluates it.
    """

    def __init__(self, left: Operator, right: Operator, method: str = "nested-loops", expr: str | None = None, left_schema: Schema | None = None, right_schema: Schema | None = None, left_key: Schema | None = None, right_key: Schema | None = None, left_hash: str | None = None, right_hash: str | None = None, index_id=None, index_key: Callable | None = None, hint: str | None = None):
        if method not in METHODS:
            raise ValueError(f"no join method {method!r}; there are {METHODS}")
        self.options = dict(method=method, expr=expr, left_schema=left_schema, right_schema=right_schema, left_key=left_key, right_key=right_key, left_hash=left_hash, right_hash=right_hash, index_id=index_id, index_key=index_key, hint=hint)
        self.left_fields, self.right_fields = (self._named(i, s) for i, s in ((left, left_schema), (right, right_schema)))
        shared = set(self.left_fields.fields) & set(self.right_fields.fields)
        if shared:
            raise ValueError(f"both inputs have the fields {sorted(shared)}; give one of them another schema")
        super().__init__(Schema(f"join_{left.schema.name}_{right.schema.name}", self.left_fields.schema() + self.right_fields.schema()), [left, right])
        self.method, self.expr, self.hint = method, expr, hint
        self.keys = self._keys(right)
        env = environment(self.schema)
        self.parts = [] if expr is None else separable(expr, env, [f"{a} == {b}" for a, b in self.keys])
        self._conditions = [self._key(a) == self._key(b) for a, b in self.keys] + [compile_predicate(c, env) for c in self.parts]

    @staticmethod
    def _named(source: Operator, schema: Schema | None) -> Schema:
        if schema is None:
            return source.schema
        if [t.text for t in schema.types] != [t.text for t in source.schema.types]:
            raise ValueError(f"{schema} does not name the fields of {source.schema}")
        return schema

    def _key(self, field: str):
        v = column_of(field, self.schema.type_of(field).kind)
        return v.column if v.day is None else v.day.cast("date")

    def _keys(self, right: Operator) -> list[tuple[str, str]]:
        o = self.options
        if self.method in ("nested-loops", "block-nested-loops"):
            if self.expr is None:
                raise ValueError(f"{self.method} needs an expression")
            return []
        if self.method == "hash":
            if None in (o["left_key"], o["right_key"], o["left_hash"], o["right_hash"]):
                raise ValueError("hash needs the keys and hash functions of both inputs")
            for text, schema in ((o["left_hash"], self.left_fields), (o["right_hash"], self.right_fields)):
                if not attributes(text) <= set(schema.fields):
                    raise ValueError(f"{text!r} is not about {schema}")
            right_key = o["right_key"]
        else:
            if o["left_key"] is None or o["index_id"] is None:
                raise ValueError("indexed needs the left key and an index")
            if not isinstance(right, TableScan):
                raise ValueError("indexed needs a relation on the right")
            at = o["index_key"](o["index_id"], right.name)
            right_key = Schema("key", [(self.right_fields.fields[right.schema.fields.index(f)], right.schema.type_of(f)) for f in at])
        pairs = list(zip(o["left_key"].fields, right_key.fields, strict=True))
        lost = [f for a, b in pairs for f, s in ((a, self.left_fields), (b, self.right_fields)) if f not in s.fields]
        if lost:
            raise ValueError(f"no key fields {lost}")
        return pairs

    def all_conditions(self) -> list[str]:
        """What pairs must meet, as expressions that may be applied in any order and place."""
        return [f"{a} == {b}" for a, b in self.keys] + self.parts

    def with_inputs(self, inputs):
        return Join(*inputs, **self.options)

    def lower(self, a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.toDF(*self.left_fields.fields), b.toDF(*self.right_fields.fields)
        if self.hint:
            b = b.hint(self.hint)
        if not self._conditions:
            return a.crossJoin(b)
        condition = self._conditions[0]
        for c in self._conditions[1:]:
            condition = condition & c
        return a.join(b, condition, "inner")

    def local_cost(self, estimated: bool = False) -> float:
        left, right = (i.cardinality(estimated) for i in self.inputs)
        if self.method == "nested-loops":
            return left * right + left
        if self.method == "block-nested-loops":
            return left + (left // (BLOCK_PAGES - 2)) * right
        return 3 * (left + right)

    def arguments(self) -> str:
        keys = [f"{a}={b}" for a, b in self.keys]
        return f"method={self.method}" + (f",keys={keys}" if keys else "") + (f",expr='{self.expr}'" if self.expr else "")


def conditions_below(node: Operator) -> list[str]:
    """The conditions that the rows of node, a tree of filters and joins, meet, as far as they are about its fields by their names."""
    from .rows import Select

    if isinstance(node, Select):
        return conditions_below(node.inputs[0]) + node.parts
    if isinstance(node, Join):
        kept = [i for i, names in zip(node.inputs, (node.left_fields, node.right_fields)) if names.fields == i.schema.fields]
        return [c for i in kept for c in conditions_below(i)] + node.all_conditions()
    return []


def all_of(parts) -> str:
    return " and ".join(f"({p})" for p in parts) or "True"
