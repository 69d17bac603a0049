"""Table scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.types import Schema
from .base import Operator


class TableScan(Operator):
    """All rows of a relation; load gives its DataFrame when the plan is lowered."""

    def __init__(self, name: str, schema: Schema, load: Callable[[], DataFrame]):
        if not name or schema is None:
            raise ValueError("a scan needs a relation and its schema")
        super().__init__(schema, [])
        self.name, self.load, self.fraction, self.seed = name, load, None, 0

    def sampled(self, fraction: float, seed: int) -> TableScan:
        out = TableScan(self.name, self.schema, self.load)
        out.fraction, out.seed = fraction, seed
        return out

    def with_inputs(self, inputs):
        return self

    def lower(self) -> DataFrame:
        df = self.load()
        return df if self.fraction is None else df.sample(fraction=self.fraction, seed=self.seed)

    def local_cost(self, estimated: bool = False) -> float:
        return float(self.cardinality(estimated))

    def arguments(self) -> str:
        return self.name
