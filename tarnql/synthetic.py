"""Queries over small made-up relations: employees and their departments, and the three-column relations of star and bushy joins."""

from __future__ import annotations

import sys

from .functions.types import Schema
from .functions.udf import RowFunction
from .sources.database import Database

# Fixed relations of the published examples: their names, their integer columns, and whether they have the further rows.
# Every relation holds the rows (i, 2 * i + 20, i % 2) for i in 0..9, and with further rows also those for i in 11..29.
RELATIONS = (
    ("Iabc", ("a", "b", "c"), True),
    ("Idef", ("d", "e", "f"), False),
    ("Ighi", ("g", "h", "i"), True),
    ("Ijkl", ("j", "k", "l"), False),
    ("Imno", ("m", "n", "o"), True),
    ("Ipqr", ("p", "q", "r"), False),
    ("Istu", ("s", "t", "u"), True),
    ("Ivwx", ("v", "w", "x"), False),
    ("Kabc", ("ka", "kb", "kc"), True),
    ("Kdef", ("kd", "ke", "kf"), False),
    ("Kghi", ("kg", "kh", "ki"), True),
    ("Kjkl", ("kj", "kk", "kl"), False),
)


def opened(spark) -> Database:
    db = Database(spark)
    number = [(i, 2 * i + 20, i % 2) for i in range(30)]
    for name, fields, more in RELATIONS:
        rows = [r for r in number if r[0] < 10 or more and r[0] > 10]
        db.attach(name, spark.createDataFrame(rows, ", ".join(f"{f} int" for f in fields)).coalesce(1), Schema(name, [(f, "int") for f in fields]))
    db.attach("employee", spark.createDataFrame(number[:20], "id int, age int, dept_id int").coalesce(1), Schema("employee", [("id", "int"), ("age", "int"), ("dept_id", "int")]))
    db.attach("department", spark.createDataFrame([r[:2] for r in number[:10]], "did int, eid int").coalesce(1), Schema("department", [("did", "int"), ("eid", "int")]))
    return db


def _from(db: Database, name: str):
    return db.query().fromTable(name)


def _star(n: int, planner: str):
    (first, *_), *others = RELATIONS[:n]

    def run(spark, sf_dir):
        db = opened(spark)
        q = _from(db, first)
        for other, fields, _ in others:
            q = q.join(_from(db, other), method="block-nested-loops", expr=f"a == {fields[0]}")
        return db.optimize(q.finalize(), planner).df()

    sql = "SELECT " + ", ".join(f"({e})::INTEGER AS {c}" for _, fields, _ in RELATIONS[:n] for c, e in zip(fields, ("i", "2 * i + 20", "i % 2"))) + " FROM range(10) t(i)"
    return run, sql


# The published bushy examples compare columns whose values never meet: j is in 0..9 and h from 20 on, i is 0 or 1 and b from 20 on, and c > f
# never holds where a == d. So they give no rows, and a wrong plan would give none either. They are registered as they are (PUBLISHED), and besides
# with predicates on the same columns in the same places that rows do meet (MEETING).
PUBLISHED = {"below": "h == j", "top": "b == i and e == k", "between": "c > f", "above": "a == h and d == 5"}
MEETING = {"below": "h == 20 + 2 * j", "top": "b == h and e == k", "between": "c >= f", "above": "a == g and d >= 5"}


def _bushy(filtered: bool, grouped: bool, on: dict[str, str] = MEETING):
    def run(spark, sf_dir):
        db = opened(spark)
        q = _from(db, "Iabc")
        q = (q.where("a < 20") if filtered else q).join(_from(db, "Idef"), method="block-nested-loops", expr="a == d")
        q = q.where(on["between"]) if filtered else q
        right = _from(db, "Ighi").join(_from(db, "Ijkl"), method="block-nested-loops", expr=on["below"])
        q = q.join(right, method="block-nested-loops", expr=on["top"])
        q = q.where(on["above"]) if filtered else q
        if grouped:
            q = q.groupBy(
                groupSchema=Schema("aKey", [("a", "int")]), aggSchema=Schema("minmax", [("minAge", "int"), ("maxAge", "int")]), groupExpr=lambda e: e.a % 2,
                aggExprs=[(sys.maxsize, lambda acc, e: min(acc, e.b), lambda x: x), (0, lambda acc, e: max(acc, e.b), lambda x: x)], groupHashFn=lambda g: hash(g[0]) % 2,
            )
        return db.optimize(q.finalize(), "bushy").df()

    return run


def employee_department(spark, sf_dir):
    db = opened(spark)
    return db.optimize(_from(db, "employee").join(_from(db, "department"), method="block-nested-loops", expr="id == eid").finalize(), "greedy").df()


def employee_department_by_number(spark, sf_dir):
    """As employee_department, whose condition no row meets, by columns that do have common values."""
    db = opened(spark)
    return db.optimize(_from(db, "employee").join(_from(db, "department"), method="block-nested-loops", expr="id == did and age >= eid").finalize(), "greedy").df()


def union_join_where(spark, sf_dir):
    db = opened(spark)
    q = _from(db, "employee").union(_from(db, "employee")).join(_from(db, "department"), method="block-nested-loops", expr="id < eid and did == dept_id")
    q = q.where("eid > 0 and id > 0 and (eid == 22 or id == 6)").select({"id": ("id", "int"), "eid": ("eid", "int")})
    return db.optimize(q.finalize()).df()


def employee_where(spark, sf_dir):
    return _from(opened(spark), "employee").where("age < 30").select({"id": ("id", "int"), "age": ("age", "int")}).finalize().df()


def employee_theta_join(spark, sf_dir):
    db = opened(spark)
    other = db.relation_schema("employee").rename("other", {"id": "id2", "age": "age2", "dept_id": "dept_id2"})
    q = _from(db, "employee").join(_from(db, "employee"), rhsSchema=other, method="nested-loops", expr="id <= id2")
    return q.select({"id": ("id", "int"), "id2": ("id2", "int")}).finalize().df()


def employee_group(spark, sf_dir):
    q = _from(opened(spark), "employee").groupBy(
        groupSchema=Schema("k", [("id", "int")]), aggSchema=Schema("m", [("minAge", "int"), ("maxAge", "int")]), groupExpr=lambda e: e.id % 2,
        aggExprs=[(sys.maxsize, lambda acc, e: min(acc, e.age), lambda x: x), (0, lambda acc, e: max(acc, e.age), lambda x: x)], groupHashFn=lambda g: hash(g[0]) % 10,
    )
    return q.finalize().df()


def employee_function(spark, sf_dir):
    """A Python function that cannot be compiled, run in Arrow batches because the query says so."""

    def digits(e):
        return "-".join(sorted(str(e.age)))

    return _from(opened(spark), "employee").select({"id": ("id", "int"), "digits": (RowFunction(digits), "text(10)"), "sum": (lambda e: e.id + e.age, "int")}).finalize().df()


_ABC = "(SELECT i AS a, 2 * i + 20 AS b, i % 2 AS c FROM range(30) t(i) WHERE i <> 10)"
_DEF = "(SELECT i AS d, 2 * i + 20 AS e, i % 2 AS f FROM range(10) t(i))"
_GHI = "(SELECT i AS g, 2 * i + 20 AS h, i % 2 AS i FROM range(30) t(i) WHERE i <> 10)"
_JKL = "(SELECT i AS j, 2 * i + 20 AS k, i % 2 AS l FROM range(10) t(i))"
_BUSHY = f"FROM {_ABC} JOIN {_DEF} ON a = d JOIN {_GHI} ON b = h JOIN {_JKL} ON h = 20 + 2 * j AND e = k"
_EMPTY = f"FROM {_ABC} JOIN {_DEF} ON a = d JOIN ({_GHI} JOIN {_JKL} ON h = j) ON b = i AND e = k"
_ALL = "SELECT " + ", ".join(f"{c}::INTEGER AS {c}" for c in "abcdefghijkl")
_SOME = "WHERE a < 20 AND c >= f AND a = g AND d >= 5"
_NONE = "WHERE a < 20 AND c > f AND a = h AND d = 5"
_MINMAX = 'SELECT (a % 2)::INTEGER AS a, min(b)::INTEGER AS "minAge", max(b)::INTEGER AS "maxAge"'
_EMPLOYEE = "(SELECT i::INTEGER AS id, (2 * i + 20)::INTEGER AS age, (i % 2)::INTEGER AS dept_id FROM range(20) t(i))"
_DEPARTMENT = "(SELECT i::INTEGER AS did, (2 * i + 20)::INTEGER AS eid FROM range(10) t(i))"

PAIRS_OF = {
    **{f"star_join_{n}_{planner.replace('-', '_')}": _star(n, planner) for n, planner in ((2, "left-deep"), (4, "bushy"), (6, "greedy"), (8, "bushy"), (10, "left-deep"), (12, "greedy"))},
    "bushy_join": (_bushy(False, False), f"{_ALL} {_BUSHY}"),
    "bushy_join_where": (_bushy(True, False), f"{_ALL} {_BUSHY} {_SOME}"),
    "bushy_join_group": (_bushy(True, True), f"{_MINMAX} {_BUSHY} {_SOME} GROUP BY 1"),
    "bushy_join_published": (_bushy(False, False, PUBLISHED), f"{_ALL} {_EMPTY}"),
    "bushy_join_where_published": (_bushy(True, False, PUBLISHED), f"{_ALL} {_EMPTY} {_NONE}"),
    "bushy_join_group_published": (_bushy(True, True, PUBLISHED), f"{_MINMAX} {_EMPTY} {_NONE} GROUP BY 1"),
    "employee_department_by_number": (employee_department_by_number, f"SELECT * FROM {_EMPLOYEE} JOIN {_DEPARTMENT} ON id = did AND age >= eid"),
    "employee_department": (employee_department, f"SELECT * FROM {_EMPLOYEE} JOIN {_DEPARTMENT} ON id = eid"),
    "union_join_where": (union_join_where, f"SELECT id, eid FROM (SELECT * FROM {_EMPLOYEE} UNION ALL SELECT * FROM {_EMPLOYEE}) JOIN {_DEPARTMENT} ON id < eid AND did = dept_id WHERE eid > 0 AND id > 0 AND (eid = 22 OR id = 6)"),
    "employee_where": (employee_where, f"SELECT id, age FROM {_EMPLOYEE} WHERE age < 30"),
    "employee_theta_join": (employee_theta_join, f"SELECT a.id, b.id AS id2 FROM {_EMPLOYEE} a JOIN {_EMPLOYEE} b ON a.id <= b.id"),
    "employee_group": (employee_group, f'SELECT id % 2 AS id, min(age) AS "minAge", max(age) AS "maxAge" FROM {_EMPLOYEE} GROUP BY 1'),
    "employee_function": (employee_function, f"""SELECT id, array_to_string(list_sort(string_split(age::VARCHAR, '')), '-') AS digits, id + age AS sum FROM {_EMPLOYEE}"""),
}


def queries() -> dict:
    return {name: run for name, (run, _) in PAIRS_OF.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PAIRS_OF.items()}
