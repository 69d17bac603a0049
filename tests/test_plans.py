"""Builder queries over the small employee relation and its kin."""

import sys

import pytest

from tarnql.functions.types import Schema
from tarnql.plans.joinorder import Bushy, Greedy, LeftDeep
from tarnql.sources.database import Database

INT2 = [("id", "int"), ("age", "int")]


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark)
    db.attach("employee", spark.createDataFrame([(i, 2 * i + 20, i % 2) for i in range(20)], "id int, age int, dept_id int").coalesce(1), Schema("employee", [*INT2, ("dept_id", "int")]))
    return db


@pytest.fixture
def employee(db):
    return db.query().fromTable("employee")


def rows(q):
    return [tuple(r) for r in q.finalize().df().collect()]


def other(db):
    s = db.relation_schema("employee")
    return s.rename("employee2", {f: f"{f}2" for f in s.fields})


def test_scan_where_select(employee):
    assert len(rows(employee)) == 20
    assert sorted(r[1] for r in rows(employee.where("age < 30"))) == [20, 22, 24, 26, 28]
    assert rows(employee.select({"id": ("id", "int")})) == [(i,) for i in range(20)]
    assert rows(employee.where("id == 3").select({"twice": ("age * 2", "int"), "half": ("age / 4", "double")})) == [(52, 6.5)]


def test_floats_are_no_integers(employee):
    with pytest.raises(TypeError):
        employee.select({"half": ("age / 2", "int")})


def test_union(db, employee):
    assert len(rows(employee.union(db.query().fromTable("employee")))) == 40
    with pytest.raises(ValueError):
        employee.union(db.query().fromTable("employee").select({"id": ("id", "int")}))


@pytest.mark.parametrize("method", ["nested-loops", "block-nested-loops"])
def test_joins(db, employee, method):
    right = db.query().fromTable("employee")
    assert len(rows(employee.join(right, method=method, rhsSchema=other(db), expr="id == id2"))) == 20
    assert len(rows(employee.join(right, method=method, rhsSchema=other(db), expr="id <= id2"))) == 210
    assert len(rows(employee.join(right, method=method, rhsSchema=other(db), expr="True"))) == 400


def test_hash_and_index_joins(db, employee):
    right = db.query().fromTable("employee")
    keys = dict(lhsHashFn="hash(id) % 4", rhsHashFn="hash(id2) % 4", lhsKeySchema=Schema("k", [("id", "int")]), rhsKeySchema=Schema("k2", [("id2", "int")]))
    assert len(rows(employee.join(right, method="hash", rhsSchema=other(db), **keys))) == 20
    assert len(rows(employee.join(right, method="hash", rhsSchema=other(db), expr="age < 30", **keys))) == 5
    index = db.create_index("employee", ["age"])
    assert len(rows(employee.join(right, method="indexed", rhsSchema=other(db), indexId=index, lhsKeySchema=Schema("k", [("age", "int")])))) == 20
    db.remove_index(index)


def test_joins_that_do_not_fit(db, employee):
    right = db.query().fromTable("employee")
    for bad in (dict(method="nested-loops", expr="id == id"), dict(method="zigzag", expr="True", rhsSchema=other(db)), dict(method="hash", rhsSchema=other(db)), dict(method="nested-loops", rhsSchema=other(db))):
        with pytest.raises(ValueError):
            employee.join(right, **bad)


def group(q, keys, key, aggs, folds):
    return q.groupBy(groupSchema=Schema("g", keys), aggSchema=Schema("a", aggs), groupExpr=key, aggExprs=folds, groupHashFn=lambda g: hash(g) % 10)


def test_group_by(employee):
    folds = [(sys.maxsize, lambda acc, e: min(acc, e.age), lambda x: x), (0, lambda acc, e: max(acc, e.age), lambda x: x)]
    q = group(employee, [("id", "int")], lambda e: e.id % 2, [("min", "int"), ("max", "int")], folds)
    assert q.operator.native and sorted(rows(q)) == [(0, 20, 56), (1, 22, 58)]
    assert rows(group(employee.where("id < 0"), [("id", "int")], lambda e: 1, [("min", "int"), ("max", "int")], folds)) == []


def test_start_takes_part(employee):
    q = group(employee, [("d", "int")], lambda e: e.dept_id, [("m", "int"), ("s", "int")], [(0, lambda acc, e: max(acc, -e.age), lambda x: x), (100, lambda acc, e: acc - e.id, lambda x: x + 1)])
    assert sorted(rows(q)) == [(0, 0, 101 - 90), (1, 0, 101 - 100)]


def test_folds_without_counterpart_run_in_order(employee):
    folds = [("", lambda acc, e: acc + chr(97 + e.id), lambda x: x), (0, lambda acc, e: acc * 2 + (1 if e.age > 40 else 0), lambda x: x)]
    q = group(employee, [("d", "int")], lambda e: e.dept_id, [("letters", "text(30)"), ("bits", "long")], folds)
    assert not q.operator.native
    want = {d: ("".join(chr(97 + i) for i in range(d, 20, 2)), int("".join("1" if 2 * i + 20 > 40 else "0" for i in range(d, 20, 2)), 2)) for d in (0, 1)}
    assert {r[0]: r[1:] for r in rows(q)} == want


def test_groups_that_do_not_fit(employee):
    for aggs, folds in (([("a", "int")], []), ([], []), ([("a", "int")], [(0, max, int)] * 2)):
        with pytest.raises(ValueError):
            group(employee, [("d", "int")], lambda e: e.dept_id, aggs, folds)


def test_order(employee):
    assert [r[0] for r in rows(employee.order(sortKeyFn=lambda e: e.age, sortKeyDesc="age"))] == list(range(19, -1, -1))
    assert [r[0] for r in rows(employee.order(sortKeyFn=lambda e: (e.dept_id, e.age), ascending=True))][:3] == [0, 2, 4]


def test_plan_utilities(db, employee):
    p = employee.join(db.query().fromTable("employee"), method="block-nested-loops", rhsSchema=other(db), expr="id == id2").where("age < 30").finalize()
    assert p.relations() == ["employee", "employee"] and len(p.joins) == 1 and len(p.sources) == 2
    assert p.cardinality() == 5 and p.cost() == 20 + 20 + 20 + 20
    lines = p.explain(costs=True).splitlines()
    assert lines[0].startswith("Select[") and "cost=80.00" in lines[0] and len(lines) == 4
    assert sum(1 for _ in p) == 5
    assert p.sample(1.0) == 5 and p.sample(1.0) == 5 and p.cardinality(estimated=True) == 5
    assert p.selectivity() == 0.25
    with pytest.raises(ValueError):
        db.query().fromTable("nobody")


def star(spark, n):
    db = Database(spark)
    for k in range(n):
        db.attach(f"t{k}", spark.createDataFrame([(i, 2 * i + 20) for i in (*range(10), *(range(11, 30) if k % 2 else ()))], f"a{k} int, b{k} int").coalesce(1))
    q = db.query().fromTable("t0")
    for k in range(1, n):
        q = q.join(db.query().fromTable(f"t{k}"), method="block-nested-loops", expr=f"a0 == a{k}")
    return db, q


@pytest.mark.parametrize(("planner", "count"), [(LeftDeep, lambda n: n * 2**n - 2 * n + n), (Bushy, lambda n: n + 2 * (3**n - 2 ** (n + 1) + 1)), (Greedy, lambda n: 4 * (n + 1) * n * (n - 1) // 6)])
def test_planners(spark, planner, count):
    for n in (2, 4, 6):
        db, q = star(spark, n)
        plan = q.where("b1 > 22 and a0 + a1 < 30").finalize()
        p = planner()
        best = p.optimize(plan)
        assert p.plan_count == count(n)
        assert best.schema().fields == plan.schema().fields
        assert sorted(map(tuple, best.df().collect())) == sorted(map(tuple, plan.df().collect())) and plan.cardinality() == 8


def test_planners_keep_what_bounds_a_region(db, employee):
    s = db.relation_schema("employee").rename("e3", {"id": "id3", "age": "age3", "dept_id": "dept_id3"})
    left = employee.union(db.query().fromTable("employee")).where("age < 30")
    q = left.join(db.query().fromTable("employee"), method="nested-loops", rhsSchema=other(db), expr="id == id2 and id < 4 and True")
    q = q.join(db.query().fromTable("employee"), method="nested-loops", rhsSchema=s, expr="dept_id2 == dept_id3").where("1 == 1 and id3 < 10")
    q = group(q, [("d", "int")], lambda e: e.dept_id, [("n", "int")], [(0, lambda acc, e: acc + 1, lambda x: x)]).where("n > 0")
    plan = q.finalize()
    for planner in ("left-deep", "bushy", "greedy"):
        assert sorted(map(tuple, db.optimize(plan, planner).df().collect())) == sorted(map(tuple, plan.df().collect())) == [(0, 20), (1, 20)]


@pytest.fixture(scope="module")
def guarded(spark):
    """Two relations: x is never 1 where y is 0, and two pairs of rows of one day have other times."""
    db = Database(spark)
    db.attach("l", spark.sql("select * from values (1, 5, timestamp_ntz'1996-01-01 00:00:00'), (2, 0, timestamp_ntz'1996-01-02 03:00:00'), (3, 0, timestamp_ntz'1996-01-03 00:00:00') t(x, y, at)"))
    db.attach("r", spark.sql("select * from values (1, 7, timestamp_ntz'1996-01-01 12:00:00'), (2, 0, timestamp_ntz'1996-01-02 00:00:00'), (9, 0, timestamp_ntz'1996-01-09 00:00:00') t(u, v, day)"))
    return db


KEYS = {
    "nested-loops": {}, "block-nested-loops": {},
    "hash": dict(lhsKeySchema=Schema("k", [("x", "int")]), rhsKeySchema=Schema("k2", [("u", "int")]), lhsHashFn="x % 4", rhsHashFn="u % 4"),
}


@pytest.mark.parametrize("method", list(KEYS))
@pytest.mark.parametrize("planner", [None, "left-deep", "bushy", "greedy"])
def test_guards_hold_in_joins_and_above(guarded, method, planner):
    def result(q):
        plan = q.finalize()
        return sorted(map(tuple, (guarded.optimize(plan, planner) if planner else plan).df().collect()))

    l, r, pick = guarded.query().fromTable("l"), guarded.query().fromTable("r"), {"x": ("x", "int"), "u": ("u", "int")}
    inside = l.join(r, method=method, expr="x == u and x == 1 and 10 // y > 1 and 14 // v == 2", **KEYS[method]).select(pick)
    assert result(inside) == [(1, 1)]
    assert result(l.join(r, method=method, expr="x == u and x == 8 and 10 // y > 1", **KEYS[method]).select(pick)) == []
    above = l.join(r, method=method, expr="x == u and x == 1", **KEYS[method]).where("10 // y > 1").where("14 // v == 2 or 3 // v > 1")
    assert result(above.select(pick)) == [(1, 1)]
    third = guarded.query().fromTable("l").select({"p": ("x", "int"), "q": ("y", "int")})
    assert result(l.join(r, method=method, expr="x == u", **KEYS[method]).join(third, expr="p == x and p < 2").where("10 // q > 1 and u > 0").select(pick)) == [(1, 1)]


@pytest.mark.parametrize("planner", [None, "left-deep", "greedy"])
def test_days_are_equal_whatever_the_time(guarded, planner):
    day = dict(lhsKeySchema=Schema("k", [("at", "date")]), rhsKeySchema=Schema("k2", [("day", "date")]), lhsHashFn="at % 4", rhsHashFn="day % 4")
    index = guarded.create_index("r", ["day"])
    l, r, pick = guarded.query().fromTable("l"), guarded.query().fromTable("r"), {"x": ("x", "int"), "u": ("u", "int")}
    try:
        for how in (dict(method="hash", **day), dict(method="nested-loops", expr="at == day"), dict(method="indexed", indexId=index, lhsKeySchema=day["lhsKeySchema"])):
            plan = l.join(r, **how).select(pick).finalize()
            assert sorted(map(tuple, (guarded.optimize(plan, planner) if planner else plan).df().collect())) == [(1, 1), (2, 2)]
        assert [x["u"] for x in guarded.lookup(index, 19960101).collect()] == [1]
    finally:
        guarded.remove_index(index)
    assert [x[0] for x in rows(l.order(sortKeyFn=lambda e: e.at))] == [3, 2, 1]


@pytest.mark.parametrize("seed", range(6))
def test_random_plans_give_the_same_rows_optimized(spark, seed):
    """Joins of three to five relations with random equalities, comparisons and guarded divisions, inside and above."""
    import random

    r, db = random.Random(seed), Database(spark)
    n = r.randint(3, 5)
    for k in range(n):
        data = [(r.randint(0, 6), r.randint(0, 3), r.randint(0, 9)) for _ in range(12)]
        db.attach(f"t{k}", spark.createDataFrame(data, f"a{k} int, b{k} int, c{k} int").coalesce(1))

    def condition(k, others):
        o = r.choice(others)
        some = [f"a{k} == a{o}", f"b{k} <= b{o}", f"c{k} + c{o} > 5", f"b{k} != 0", f"10 // b{k} > 2", f"c{o} % 3 == 1", f"(b{o} == 0 or 6 // b{o} < 4)"]
        parts = r.sample(some[1:], r.randint(0, 3))
        if any(x.startswith("10 //") for x in parts):  # the guard of a division comes before it
            parts = [f"b{k} != 0"] + [x for x in parts if x != f"b{k} != 0"]
        return " and ".join([some[0], *parts])

    q = db.query().fromTable("t0")
    for k in range(1, n):
        q = q.join(db.query().fromTable(f"t{k}"), method="block-nested-loops", expr=condition(k, list(range(k))))
        if r.random() < 0.5:
            q = q.where(f"b{k} > 0").where(f"12 // b{k} > 3 or c0 > 4")
    plan = q.finalize()
    want = sorted(map(tuple, plan.df().collect()))
    for planner in ("left-deep", "bushy", "greedy"):
        assert sorted(map(tuple, db.optimize(plan, planner).df().collect())) == want


def test_planners_look_at_few_rows_of_large_inputs(spark, tmp_path):
    """Estimates of a relation in files come from its size and some rows; filters are not run over it."""
    from tarnql.plans.joinorder import _looked_at

    spark.range(200000).selectExpr("id as big_id", "cast(id % 50 as int) as kind", "cast(id % 4 as int) as part").write.parquet(str(tmp_path / "big"))
    db = Database(spark)
    db.attach("big", spark.read.parquet(str(tmp_path / "big")))
    node = db.query().fromTable("big").where("part == 1").operator
    total, distinct = _looked_at(node, [], ["big_id", "kind"], 2000)
    assert 5000 < total < 200000 and distinct["big_id"] == total and 12 <= distinct["kind"] <= 25
