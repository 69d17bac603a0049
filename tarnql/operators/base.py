"""What all operators have: inputs, a schema, a DataFrame, costs and a line in an explanation."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.types import Schema

_numbers = itertools.count(1)


class Operator:
    """A node of a plan. lower() turns its inputs' DataFrames into its own; nothing runs until a result is asked for."""

    def __init__(self, schema: Schema, inputs: Sequence[Operator]):
        self.id, self.schema, self.inputs = next(_numbers), schema, list(inputs)
        self._df: DataFrame | None = None
        self._rows: int | None = None
        self._estimate: float | None = None

    def lower(self, *inputs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def with_inputs(self, inputs: Sequence[Operator]) -> Operator:
        """A node like this one over other inputs."""
        raise NotImplementedError

    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.lower(*(i.df() for i in self.inputs))
        return self._df

    def cardinality(self, estimated: bool = False) -> float:
        """Rows of the result: counted, or from the last sample."""
        if estimated:
            return self._estimate if self._estimate is not None else 0.0
        if self._rows is None:
            self._rows = self.df().count()
        return self._rows

    def selectivity(self, estimated: bool = False) -> float:
        taken = sum(i.cardinality(estimated) for i in self.inputs)
        return self.cardinality(estimated) / taken if taken else 0.0

    def local_cost(self, estimated: bool = False) -> float:
        return float(sum(i.cardinality(estimated) for i in self.inputs))

    def cost(self, estimated: bool = False) -> float:
        return self.local_cost(estimated) + sum(i.cost(estimated) for i in self.inputs)

    def arguments(self) -> str:
        return ""

    def line(self, cost: Callable[[Operator], float] | None = None) -> str:
        shown = f"{cost(self):.2f}" if cost else "?"
        return f"{type(self).__name__}[{self.id},cost={shown}]({self.arguments()})"

    def walk(self, depth: int = 0):
        """(node, depth) in pre-order, right inputs first."""
        yield self, depth
        for i in reversed(self.inputs):
            yield from i.walk(depth + 1)
