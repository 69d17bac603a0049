"""The fluent query builder."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from ..functions.types import Schema
from ..operators.base import Operator
from ..operators.group import GroupBy
from ..operators.join import Join
from ..operators.rows import Project, Select, Sort, UnionAll
from .plan import Plan


class PlanBuilder:
    """Builds a plan step by step; every method returns a new builder, and what does not fit is an error at once."""

    def __init__(self, db, operator: Operator | None = None):
        self.db, self.operator = db, operator

    def _next(self, operator: Operator) -> PlanBuilder:
        return PlanBuilder(self.db, operator)

    def _current(self) -> Operator:
        if self.operator is None:
            raise ValueError("a query begins with fromTable")
        return self.operator

    @staticmethod
    def _operator(query) -> Operator:
        return query.root if isinstance(query, Plan) else query._current()

    def fromTable(self, name: str) -> PlanBuilder:
        return self._next(self.db.scan(name))

    def where(self, expression: str) -> PlanBuilder:
        return self._next(Select(self._current(), expression))

    def select(self, columns: Mapping[str, tuple[str, str]]) -> PlanBuilder:
        return self._next(Project(self._current(), columns))

    def join(
        self, other, method: str = "nested-loops", expr: str | None = None, lhsSchema: Schema | None = None, rhsSchema: Schema | None = None, lhsKeySchema: Schema | None = None,
        rhsKeySchema: Schema | None = None, lhsHashFn: str | None = None, rhsHashFn: str | None = None, indexId=None, hint: str | None = None,
    ) -> PlanBuilder:
        names = dict(left_schema=lhsSchema, right_schema=rhsSchema, left_key=lhsKeySchema, right_key=rhsKeySchema, left_hash=lhsHashFn, right_hash=rhsHashFn)
        return self._next(Join(self._current(), self._operator(other), method, expr, index_id=indexId, index_key=self.db.index_key, hint=hint, **names))

    def union(self, other) -> PlanBuilder:
        return self._next(UnionAll(self._current(), self._operator(other)))

    def groupBy(self, groupSchema: Schema, aggSchema: Schema, groupExpr: Callable, aggExprs: Sequence, groupHashFn: Callable) -> PlanBuilder:
        return self._next(GroupBy(self._current(), groupSchema, aggSchema, groupExpr, aggExprs, groupHashFn))

    def order(self, sortKeyFn: Callable, sortKeyDesc: str = "", ascending: bool = False) -> PlanBuilder:
        return self._next(Sort(self._current(), sortKeyFn, sortKeyDesc, ascending))

    def finalize(self) -> Plan:
        return Plan(self._current())
