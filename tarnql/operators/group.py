"""Grouping with fold aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.folds import Fold, builtin, keys_of, streamed
from ..functions.types import Schema
from .base import Operator
from .rows import checked


class GroupBy(Operator):
    """One row for each value of the group expression: its fields, then those of the aggregates.

    An input without rows has no groups, also where the key is a constant. hash_fn only places groups, and is not used.
    """

    def __init__(self, source: Operator, group_schema: Schema, agg_schema: Schema, group_expr: Callable, aggs: Sequence, hash_fn: Callable):
        if None in (group_schema, agg_schema, group_expr, aggs, hash_fn):
            raise ValueError("a grouping needs both schemas, the group expression, the aggregates and the hash function")
        folds = [a if isinstance(a, Fold) else Fold(*a) for a in aggs]
        if not folds or len(folds) != len(agg_schema.fields):
            raise ValueError("a grouping needs as many aggregates as its schema has fields, and one at least")
        super().__init__(Schema(f"group_{source.schema.name}", group_schema.schema() + agg_schema.schema()), [source])
        self.options = (group_schema, agg_schema, group_expr, aggs, hash_fn)
        self.folds = folds
        keys = keys_of(group_expr, source.schema)
        if len(keys) != len(group_schema.fields):
            raise ValueError("the group expression and its schema differ in length")
        self._keys = [checked(k, t, f) for k, t, f in zip(keys, group_schema.types, group_schema.fields)]
        values = [builtin(f, source.schema) for f in folds]
        self.native = None not in values
        self._aggs = [checked(v, t, f) for v, t, f in zip(values, agg_schema.types, agg_schema.fields)] if self.native else []

    def with_inputs(self, inputs):
        return GroupBy(inputs[0], *self.options)

    def lower(self, df: DataFrame) -> DataFrame:
        if self.native:
            return df.groupBy(*self._keys).agg(*self._aggs)
        return streamed(df, self.inputs[0].schema, self._keys, self.folds, self.options[0], self.options[1])

    def local_cost(self, estimated: bool = False) -> float:
        return 2.0 * self.inputs[0].cardinality(estimated)

    def arguments(self) -> str:
        return f"groupSchema={self.options[0]},aggSchema={self.options[1]}"
