"""Row functions that are no expressions: compiled where that is possible, in Python only where a query asks for it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import ExpressionError, TracedRow, Untraceable, Value, compile_expression, environment, trace, traced_node
from .types import Schema, Type


class RowFunction:
    """Marks a Python function of a row to be run as it is, over Arrow batches. The plan is not optimised through it."""

    def __init__(self, function: Callable):
        self.function = function
        self.__name__ = getattr(function, "__name__", "function")


def compile_function(function: Callable, schema: Schema) -> Value:
    """A plain function of a row as an expression; an error if it is none."""
    try:
        return compile_expression(traced_node(trace(function, TracedRow(schema.fields))), environment(schema))
    except Untraceable as e:
        raise ExpressionError(f"{function} cannot be compiled ({e}); RowFunction runs it in Python") from e


def python_column(function: RowFunction, schema: Schema, kind: Type) -> Column:
    """A column of a type whose values a Python function makes of each row."""
    call, row, days = function.function, schema.instantiate, [t.kind == "date" for t in schema.types]

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([call(row(*values)) for values in zip(*columns)], dtype="object")

    values = [environment(schema)[f].column if d else F.col(f"`{f}`") for f, d in zip(schema.fields, days)]
    spark = {"int": "long", "float": "double", "str": "string"}[kind.kind]
    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return kind.stored(F.pandas_udf(run, spark)(*values))
