"""Operators on single rows, unions and sorts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ..functions.expressions import compile_expression, compile_predicate, environment, separable
from ..functions.folds import keys_of
from ..functions.types import Schema, Type
from ..functions.udf import RowFunction, compile_function, python_column
from .base import Operator
from .join import all_of, conditions_below


class Select(Operator):
    """The rows for which an expression is true. Above joins an operand that can fail is guarded by their conditions as well, since
    Catalyst moves filters below joins."""

    def __init__(self, source: Operator, expression: str):
        super().__init__(source.schema, [source])
        self.expression = expression
        env = environment(source.schema)
        compile_predicate(expression, env)  # what cannot be lowered is an error here
        self.parts = separable(expression, env, conditions_below(source))
        self._column = compile_predicate(all_of(self.parts), env)

    def with_inputs(self, inputs):
        return Select(inputs[0], self.expression)

    def lower(self, df: DataFrame) -> DataFrame:
        return df.where(self._column)

    def arguments(self) -> str:
        return f"predicate='{self.expression}'"


def checked(value, kind: Type, field: str):
    """A value as a column of a declared type; a float is no integer and a string no number, as in the relations' own format."""
    fits = {"int": ("int", "bool"), "float": ("float", "int", "bool"), "str": ("str",), "date": ("int",)}[kind.kind]
    if value.kind not in fits:
        raise TypeError(f"{field}: a {value.kind} is no {kind}")
    if kind.kind == "date":
        if value.day is None:
            raise TypeError(f"{field}: only a column of days can be a date")
        return value.day.cast("date").alias(field)
    column = value.column.cast("long") if value.kind == "bool" else value.column
    return kind.stored(column).alias(field)


class Project(Operator):
    """Columns computed from expressions, as {name: (expression, type)}; duplicates stay. Instead of an expression there may be a
    function of the row, which is compiled, or a RowFunction, which is not."""

    def __init__(self, source: Operator, columns: Mapping[str, tuple[str, str]]):
        if not columns:
            raise ValueError("a projection needs a column")
        super().__init__(Schema(f"project_{source.schema.name}", [(c, t) for c, (_, t) in columns.items()]), [source])
        self.columns = dict(columns)
        env = environment(source.schema)
        self._columns = []
        for (c, (e, _)), t in zip(columns.items(), self.schema.types):
            if isinstance(e, RowFunction):
                self._columns.append(python_column(e, source.schema, t).alias(c))
            else:
                self._columns.append(checked(compile_function(e, source.schema) if callable(e) else compile_expression(e, env), t, c))

    def with_inputs(self, inputs):
        return Project(inputs[0], self.columns)

    def lower(self, df: DataFrame) -> DataFrame:
        return df.select(*self._columns)

    def arguments(self) -> str:
        return f"projections={dict((c, getattr(e, '__name__', e)) for c, (e, _) in self.columns.items())}"


class UnionAll(Operator):
    """All rows of both inputs, which have the same fields and types."""

    def __init__(self, left: Operator, right: Operator):
        if not left.schema.match(right.schema):
            raise ValueError(f"a union of different schemas: {left.schema} and {right.schema}")
        super().__init__(left.schema, [left, right])

    def with_inputs(self, inputs):
        return UnionAll(*inputs)

    def lower(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b)


class Sort(Operator):
    """Rows in the order of a function of the row, largest first unless ascending; ties in the order of all columns."""

    def __init__(self, source: Operator, key: Callable, label: str = "", ascending: bool = False):
        super().__init__(source.schema, [source])
        self.key, self.label, self.ascending = key, label, ascending
        self._keys = [v.column if v.day is None else v.day.cast("date") for v in keys_of(key, source.schema)]

    def with_inputs(self, inputs):
        return Sort(inputs[0], self.key, self.label, self.ascending)

    def lower(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*[k.asc() if self.ascending else k.desc() for k in self._keys], *df.columns)

    def arguments(self) -> str:
        return f"key='{self.label}'"
