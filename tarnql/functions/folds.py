"""Fold aggregates: (start, step(acc, row), finish(acc)) over the rows of a group.

A fold is run once over stand-ins. If its step adds to the accumulator, or takes the smaller or larger of it and something of the
row, or does so for each item of a tuple, it becomes a built-in aggregate with partial aggregation before the exchange. Any other
fold runs as it is over each group's rows in order, as a stream: one row and one accumulator at a time.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import Lowered, Traced, TracedRow, Untraceable, Value, compile_expression, environment, trace, traced_node
from .types import Schema

ACC = "__acc"


def identity(x):
    return x


@dataclass
class Fold:
    start: object
    step: Callable
    finish: Callable = identity


@dataclass
class _Item:
    """A recognised accumulator: the built-in aggregate over the rows, and how the start takes part."""

    how: str
    over: ast.AST
    start: object


def _recognise(step: ast.AST, acc: str, start) -> _Item | None:
    def is_acc(n):
        return isinstance(n, ast.Name) and n.id == acc

    def free(n):
        return not any(is_acc(x) for x in ast.walk(n))

    if isinstance(step, ast.BinOp) and isinstance(step.op, (ast.Add, ast.Sub)):
        if is_acc(step.left) and free(step.right):
            return _Item("add" if isinstance(step.op, ast.Add) else "subtract", step.right, start)
        if is_acc(step.right) and free(step.left) and isinstance(step.op, ast.Add):
            return _Item("add", step.left, start)
    if isinstance(step, ast.Call) and isinstance(step.func, ast.Name) and step.func.id in ("min", "max") and len(step.args) == 2:
        for a, b in (step.args, step.args[::-1]):
            if is_acc(a) and free(b):
                return _Item(step.func.id, b, start)
    return None


def recognise(fold: Fold, schema: Schema) -> tuple[list[_Item], bool] | None:
    """The fold's accumulators as built-in aggregates and whether they are a tuple; None if some have no counterpart."""
    many = isinstance(fold.start, tuple)
    starts = fold.start if many else (fold.start,)
    if any(not isinstance(x, (int, float)) or isinstance(x, bool) for x in starts):
        return None
    stand = tuple(Traced(ast.Name(f"{ACC}{k}", ast.Load())) for k in range(len(starts)))
    try:
        out = trace(fold.step, stand if many else stand[0], TracedRow(schema.fields))
        finished = trace(fold.finish, stand if many else stand[0])
    except Untraceable:
        return None
    out = out if many and isinstance(out, tuple) else (out,)
    if len(out) != len(starts) or isinstance(finished, tuple):
        return None
    items = [_recognise(traced_node(x), f"{ACC}{k}", s) for k, (x, s) in enumerate(zip(out, starts))]
    return None if None in items else (items, many)


def _aggregate(item: _Item, env) -> Value:
    over = compile_expression(item.over, env)
    if over.kind not in ("int", "float"):
        raise ValueError("folds are over numbers")
    both = "int" if over.kind == "int" and isinstance(item.start, int) else "float"
    column = over.column if both == "int" else over.column.cast("double")
    start = F.lit(item.start).cast("long" if both == "int" else "double")
    if item.how in ("min", "max"):
        return Value(F.least(start, F.min(column)) if item.how == "min" else F.greatest(start, F.max(column)), both)
    return Value(start + F.sum(column) if item.how == "add" else start - F.sum(column), both)


def builtin(fold: Fold, schema: Schema) -> Value | None:
    """The fold as an aggregate column, or None."""
    found = recognise(fold, schema)
    if found is None:
        return None
    items, many = found
    try:
        values = [_aggregate(x, environment(schema)) for x in items]
        accs = tuple(Traced(Lowered(v)) for v in values)
        return compile_expression(traced_node(trace(fold.finish, accs if many else accs[0])), {})
    except (ValueError, Untraceable):
        return None


def keys_of(function: Callable, schema: Schema) -> list[Value]:
    """The group key, or sort key, that a function of the row gives: one value or a tuple of them."""
    out = trace(function, TracedRow(schema.fields))
    return [compile_expression(traced_node(x), environment(schema)) for x in (out if isinstance(out, tuple) else (out,))]


def streamed(df: DataFrame, schema: Schema, keys: Sequence[Column], folds: Sequence[Fold], key_schema: Schema, fold_schema: Schema) -> DataFrame:
    """Groups by keys and runs folds in Python, over rows in the order in which df has them.

    A group's rows are sorted and read as a stream by one task; its size does not matter for memory. Folds that are no built-in
    aggregate have no way to combine parts, so a group is not split.
    """
    names = [f"_k{k}" for k in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.monotonically_increasing_id().alias("_at"), *[F.col(f"`{f}`") for f in schema.fields])
    n, outputs = len(names), [*key_schema.struct(), *fold_schema.struct()]
    kinds = [t.kind for t in schema.types]
    fields = [f.name for f in outputs]

    def number(x):
        return x.year * 10000 + x.month * 100 + x.day

    def run(batches):
        seen, accs, done = None, None, []

        def close():
            if seen is not None:
                done.append((*seen, *(f.finish(a) for f, a in zip(folds, accs))))

        def flush():
            data = list(zip(*done)) or [()] * len(fields)
            out = pa.RecordBatch.from_arrays([pa.array(list(x), arrow[name]) for name, x in zip(fields, data)], fields)
            done.clear()
            return out

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            columns[n + 1 :] = [[number(x) for x in c] if kind == "date" else c for c, kind in zip(columns[n + 1 :], kinds)]
            for row in zip(*columns):
                if row[:n] != seen:
                    close()
                    seen, accs = row[:n], [f.start for f in folds]
                value = schema.instantiate(*row[n + 1 :])
                accs = [f.step(a, value) for f, a in zip(folds, accs)]
            if len(done) >= 10000:
                yield flush()
        close()
        yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {f.name: to_arrow_type(f.dataType) for f in outputs}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs)
    return rows.repartition(*names).sortWithinPartitions(*names, "_at").mapInArrow(run, ddl)
