"""The registered queries over relations, built with the fluent builder, and DuckDB SQL for the same rows."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions.types import Schema
from .plans.plan import Plan
from .sources.database import Database
from .sources.scratch import scratch_folder
from .sources.workload import random_reads, run_workload

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def opened(spark: SparkSession, sf_dir: str) -> Database:
    """A database over the driver's Parquet tables; nothing is read until a query needs it."""
    db = Database(spark)
    for name in TABLES:
        db.attach(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return db


def _text(n: int = 2147483647) -> str:
    return f"text({n})"


def _group(*fields):
    return Schema("groups", list(fields))


def _zero(_):
    return 0


def total(field):
    """A fold that sums what a function of the row gives."""
    return (0.0, lambda acc, e: acc + field(e), lambda x: round(x, 4))


def scan(spark, sf_dir):
    return opened(spark, sf_dir).query().fromTable("nation").finalize().df()


def sampled_scan(spark, sf_dir):
    """What a sample must be: rows of the relation, the same again with the same seed, others with another, and as many as six deviations around the fraction allow."""
    db = opened(spark, sf_dir)
    all_, (one, again, other) = db.df("orders"), (db.scan("orders").sampled(0.1, seed).df().select("o_orderkey") for seed in (1, 1, 2))
    n = all_.agg(F.count("*").alias("n"))
    counts = one.agg(F.count("*").alias("taken")).crossJoin(n)
    spread = F.lit(6.0) * F.sqrt(F.col("n") * 0.1 * 0.9)
    missing = lambda a, b: a.join(b, "o_orderkey", "left_anti").agg(F.count("*"))
    as_count = lambda df, name: df.toDF(name)
    out = counts.crossJoin(as_count(missing(one, all_), "strange")).crossJoin(as_count(missing(one, again), "changed")).crossJoin(as_count(missing(one, other), "fresh"))
    return out.select((F.abs(F.col("taken") - F.col("n") * 0.1) <= spread).alias("share_holds"), "strange", "changed", (F.col("fresh") > 0).alias("seed_counts"))


def where_and_or(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("lineitem").where("(l_quantity < 5 or l_quantity >= 49) and not l_discount > 0.03 and 19960101 <= l_shipdate < 19970101")
    return q.select({"l_orderkey": ("l_orderkey", "long"), "l_linenumber": ("l_linenumber", "int")}).finalize().df()


def project_expr(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("part").select({
        "p_partkey": ("p_partkey", "long"), "halved": ("-p_size // 2", "long"), "left_over": ("-p_size % 7", "long"), "squared": ("p_size ** 2", "long"),
        "size_class": ("'large' if p_size > 25 else 'small'", _text(5)), "brand": ("p_brand.upper() + '/' + p_brand[-2:]", _text(40)),
        "dear": ("1 if 'a' in p_name and p_retailprice > 1000 else 0", "int"), "size_in": ("1 if p_size in (1, 2, 3) else 0", "int"),
    })
    return q.finalize().df()


def union_all(spark, sf_dir):
    db = opened(spark, sf_dir)
    keys = {"l_orderkey": ("l_orderkey", "long"), "l_linenumber": ("l_linenumber", "int")}
    small = db.query().fromTable("lineitem").where("l_quantity < 3").select(keys)
    return small.union(db.query().fromTable("lineitem").select(keys)).finalize().df()


def join_nl_theta(spark, sf_dir):
    db = opened(spark, sf_dir)
    q = db.query().fromTable("nation").join(db.query().fromTable("region"), method="nested-loops", expr="n_regionkey <= r_regionkey")
    return q.finalize().df()


def _orders_customers(spark, sf_dir, index: bool = False, **how) -> DataFrame:
    db = opened(spark, sf_dir)
    if index:
        how["indexId"] = db.create_index("customer", ["c_custkey"])
    q = db.query().fromTable("orders").join(db.query().fromTable("customer"), **how)
    return q.select({"o_orderkey": ("o_orderkey", "long"), "c_custkey": ("c_custkey", "long"), "c_nationkey": ("c_nationkey", "int")}).finalize().df()


_KEYS = dict(lhsKeySchema=Schema("l", [("o_custkey", "long")]), rhsKeySchema=Schema("r", [("c_custkey", "long")]), lhsHashFn="hash(o_custkey) % 8", rhsHashFn="hash(c_custkey) % 8")


def join_bnl_equi(spark, sf_dir):
    return _orders_customers(spark, sf_dir, method="block-nested-loops", expr="o_custkey == c_custkey")


def join_hash(spark, sf_dir):
    return _orders_customers(spark, sf_dir, method="hash", **_KEYS)


def join_hash_residual(spark, sf_dir):
    return _orders_customers(spark, sf_dir, method="hash", expr="o_totalprice > c_acctbal * 10", **_KEYS)


def join_indexed(spark, sf_dir):
    return _orders_customers(spark, sf_dir, index=True, method="indexed", lhsKeySchema=_KEYS["lhsKeySchema"])


def join_self_rename(spark, sf_dir):
    db = opened(spark, sf_dir)
    nation = db.relation_schema("nation")
    other = nation.rename("other", {f: f"o_{f}" for f in nation.fields})
    q = db.query().fromTable("nation").join(db.query().fromTable("nation"), rhsSchema=other, method="nested-loops", expr="n_regionkey == o_n_regionkey and n_nationkey < o_n_nationkey")
    return q.finalize().df()


def cross(spark, sf_dir):
    db = opened(spark, sf_dir)
    return db.query().fromTable("nation").join(db.query().fromTable("region"), method="block-nested-loops", expr="True").finalize().df()


def group_min_max(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("lineitem").groupBy(
        groupSchema=_group(("l_returnflag", _text())), aggSchema=_group(("min_quantity", "double"), ("max_price", "double")), groupExpr=lambda e: e.l_returnflag,
        aggExprs=[(sys.maxsize, lambda acc, e: min(acc, e.l_quantity), lambda x: x), (0, lambda acc, e: max(acc, e.l_extendedprice), lambda x: x)], groupHashFn=_zero,
    )
    return q.finalize().df()


def group_computed_key(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("orders").groupBy(
        groupSchema=_group(("k", "long"), ("urgent", "long")), aggSchema=_group(("n", "long"), ("mean_price", "double")), groupExpr=lambda e: (e.o_custkey % 10, len(e.o_orderpriority)),
        aggExprs=[(0, lambda acc, e: acc + 1, lambda x: x), ((0, 0), lambda acc, e: (acc[0] + e.o_totalprice, acc[1] + 1), lambda acc: round(acc[0] / acc[1], 2))], groupHashFn=_zero,
    )
    return q.finalize().df()


def group_multi_key(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("lineitem").groupBy(
        groupSchema=_group(("l_returnflag", _text()), ("l_linestatus", _text())), aggSchema=_group(("sum_qty", "double"), ("n", "long")), groupExpr=lambda e: (e.l_returnflag, e.l_linestatus),
        aggExprs=[total(lambda e: e.l_quantity), (0, lambda acc, e: acc + 1, lambda x: x)], groupHashFn=_zero,
    )
    return q.finalize().df()


def _everything(q, name: str, field):
    return q.groupBy(groupSchema=_group(("dummy", "int")), aggSchema=_group((name, "double")), groupExpr=lambda e: 1, aggExprs=[total(field)], groupHashFn=_zero)


def group_global_dummy(spark, sf_dir):
    return _everything(opened(spark, sf_dir).query().fromTable("orders"), "revenue", lambda e: e.o_totalprice).finalize().df()


def group_empty(spark, sf_dir):
    return _everything(opened(spark, sf_dir).query().fromTable("orders").where("o_totalprice < 0"), "revenue", lambda e: e.o_totalprice).finalize().df()


def group_max_init0(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("customer").groupBy(
        groupSchema=_group(("c_mktsegment", _text())), aggSchema=_group(("top", "double")), groupExpr=lambda e: e.c_mktsegment,
        aggExprs=[(0, lambda acc, e: max(acc, -e.c_acctbal - 5000), lambda x: round(x, 2))], groupHashFn=_zero,
    )
    return q.finalize().df()


def group_custom_fold(spark, sf_dir):
    """A fold without a built-in counterpart: the two largest prices of each customer segment, in one accumulator."""

    def step(acc, e):
        return tuple(sorted((*acc, e.c_acctbal), reverse=True)[:2])

    q = opened(spark, sf_dir).query().fromTable("customer").groupBy(
        groupSchema=_group(("c_mktsegment", _text())), aggSchema=_group(("second", "double")), groupExpr=lambda e: e.c_mktsegment,
        aggExprs=[((), step, lambda acc: acc[-1])], groupHashFn=_zero,
    )
    return q.finalize().df()


def order_desc(spark, sf_dir):
    """The sorted rows with their places, which are numbered as the result comes."""
    df = opened(spark, sf_dir).query().fromTable("supplier").order(sortKeyFn=lambda e: e.s_acctbal, sortKeyDesc="s_acctbal").finalize().df()
    placed = df.withColumn("at", F.monotonically_increasing_id())
    return placed.withColumn("place", F.row_number().over(W.orderBy("at"))).drop("at")


def date_int(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("orders").where("o_orderdate // 100 == 199607 or o_orderdate == 19970101")
    return q.select({"o_orderkey": ("o_orderkey", "long"), "day": ("o_orderdate", "int")}).finalize().df()


def tpch_q6(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("lineitem").where("19960101 <= l_shipdate < 19970101 and 0.05 < l_discount < 0.07 and l_quantity < 24")
    return _everything(q, "revenue", lambda e: e.l_extendedprice * e.l_discount).finalize().df()


def tpch_q14(spark, sf_dir):
    db = opened(spark, sf_dir)
    q = db.query().fromTable("lineitem").join(db.query().fromTable("part"), method="block-nested-loops", expr="l_partkey == p_partkey")
    return _everything(q.where("l_shipdate >= 19950901 and l_shipdate < 19951001"), "revenue", lambda e: e.l_extendedprice * (1 - e.l_discount)).finalize().df()


def tpch_q3(spark, sf_dir):
    db = opened(spark, sf_dir)
    q = db.query().fromTable("customer").join(db.query().fromTable("orders"), method="block-nested-loops", expr="c_custkey == o_custkey")
    q = q.join(db.query().fromTable("lineitem"), method="block-nested-loops", expr="l_orderkey == o_orderkey")
    q = q.where("c_mktsegment == 'BUILDING' and o_orderdate < 19980315 and l_shipdate > 19980315")
    q = q.groupBy(
        groupSchema=_group(("l_orderkey", "long"), ("o_orderdate", "int")), aggSchema=_group(("revenue", "double")), groupExpr=lambda e: (e.l_orderkey, e.o_orderdate),
        aggExprs=[total(lambda e: e.l_extendedprice * (1 - e.l_discount))], groupHashFn=_zero,
    )
    return q.finalize().df()


def tpch_q10(spark, sf_dir):
    db = opened(spark, sf_dir)
    q = db.query().fromTable("nation").join(db.query().fromTable("customer"), method="block-nested-loops", expr="c_nationkey == n_nationkey")
    q = q.join(db.query().fromTable("orders"), method="block-nested-loops", expr="c_custkey == o_custkey")
    q = q.join(db.query().fromTable("lineitem"), method="block-nested-loops", expr="l_orderkey == o_orderkey")
    q = q.where("o_orderdate >= 19961001 and o_orderdate < 19970101 and l_returnflag == 'R'")
    q = q.groupBy(
        groupSchema=_group(("c_custkey", "long"), ("c_name", _text()), ("c_acctbal", "double"), ("n_name", _text())), aggSchema=_group(("revenue", "double")),
        groupExpr=lambda e: (e.c_custkey, e.c_name, e.c_acctbal, e.n_name), aggExprs=[total(lambda e: e.l_extendedprice * (1 - e.l_discount))], groupHashFn=_zero,
    )
    return q.finalize().df()


def q5_plan(db: Database) -> Plan:
    q = db.query().fromTable("customer").join(db.query().fromTable("orders"), method="block-nested-loops", expr="c_custkey == o_custkey")
    q = q.join(db.query().fromTable("lineitem"), method="block-nested-loops", expr="l_orderkey == o_orderkey")
    q = q.join(db.query().fromTable("supplier"), method="block-nested-loops", expr="l_suppkey == s_suppkey and c_nationkey == s_nationkey")
    q = q.join(db.query().fromTable("nation"), method="block-nested-loops", expr="s_nationkey == n_nationkey")
    q = q.join(db.query().fromTable("region"), method="block-nested-loops", expr="n_regionkey == r_regionkey")
    q = q.where("r_name == 'ASIA' and 19960101 <= o_orderdate and o_orderdate < 19970101")
    return q.groupBy(
        groupSchema=_group(("n_name", _text())), aggSchema=_group(("revenue", "double")), groupExpr=lambda e: e.n_name,
        aggExprs=[total(lambda e: e.l_extendedprice * (1 - e.l_discount))], groupHashFn=_zero,
    ).finalize()


def tpch_q5(spark, sf_dir):
    return q5_plan(opened(spark, sf_dir)).df()


def _q5_by(planner: str):
    def run(spark, sf_dir):
        db = opened(spark, sf_dir)
        return db.optimize(q5_plan(db), planner).df()

    return run


def index_lookup(spark, sf_dir):
    db = opened(spark, sf_dir)
    return db.lookup(db.create_index("orders", ["o_custkey"]), 7)


def index_scan(spark, sf_dir):
    db = opened(spark, sf_dir)
    return db.scan_by_index(db.create_index("supplier", ["s_suppkey"], primary=True)).select("s_suppkey", "s_name")


def random_point_reads(spark, sf_dir):
    """Mode 2 of the read workload: as many reads as there are rows, each of a whole row that exists, a fifth of them of rows at random (so
    that nearly 0.2 * (1 - 1 / e ** 0.2) of the rows are not read, and as many reads are repeats)."""
    rows = opened(spark, sf_dir).df("orders")
    got = random_reads(rows, 0.2)
    times = got.groupBy(*got.columns).agg(F.count("*").alias("times"))
    kept = rows.join(times, rows.columns, "left").agg(F.sum("times").alias("reads"), F.sum(F.when(F.col("times").isNull(), 1).otherwise(0)).alias("unread"), F.count("*").alias("n"))
    return kept.select("reads", F.col("unread").between(F.col("n") * 0.12, F.col("n") * 0.21).alias("a_fifth_at_random"))


def join_guarded(spark, sf_dir):
    """A division that is only reached for pairs that meet the rest: l_linenumber - 2 is 0 for many rows."""
    db = opened(spark, sf_dir)
    q = db.query().fromTable("lineitem").join(db.query().fromTable("orders"), method="block-nested-loops", expr="l_orderkey == o_orderkey and l_linenumber > 2 and 10 // (l_linenumber - 2) > 4")
    return q.select({"l_orderkey": ("l_orderkey", "long"), "l_linenumber": ("l_linenumber", "int")}).finalize().df()


def _guarded_above(db):
    q = db.query().fromTable("lineitem").join(db.query().fromTable("orders"), method="block-nested-loops", expr="l_orderkey == o_orderkey and l_linenumber > 2")
    q = q.join(db.query().fromTable("customer"), method="block-nested-loops", expr="o_custkey == c_custkey").where("c_nationkey < 10").where("10 // (l_linenumber - 2) > 4 and o_totalprice > 1000")
    return q.select({"l_orderkey": ("l_orderkey", "long"), "l_linenumber": ("l_linenumber", "int"), "c_custkey": ("c_custkey", "long")}).finalize()


def where_above_guarded(spark, sf_dir):
    return _guarded_above(opened(spark, sf_dir)).df()


def optimize_guarded(spark, sf_dir):
    db = opened(spark, sf_dir)
    return db.optimize(_guarded_above(db), "bushy").df()


def _days(spark, sf_dir):
    """Orders of one day at different times: twelve hours are added to every other one."""
    db = opened(spark, sf_dir)
    moved = db.df("orders").selectExpr("o_orderkey as m_orderkey", "case when o_orderkey % 2 = 0 then o_orderdate + interval 12 hours else o_orderdate end as m_date")
    db.attach("moved", moved)
    return db


def join_day_keys(spark, sf_dir):
    """A hash join by a day that has times behind it."""
    db = _days(spark, sf_dir)
    keys = dict(lhsKeySchema=Schema("l", [("o_orderdate", "date")]), rhsKeySchema=Schema("r", [("m_date", "date")]), lhsHashFn="hash(o_orderdate) % 8", rhsHashFn="hash(m_date) % 8")
    q = db.query().fromTable("orders").where("o_orderkey % 7 == 0").join(db.query().fromTable("moved"), method="hash", expr="o_orderkey == m_orderkey", **keys)
    return q.select({"o_orderkey": ("o_orderkey", "long"), "day": ("m_date", "int")}).finalize().df()


def join_day_expression(spark, sf_dir):
    """The same by an expression, optimized."""
    db = _days(spark, sf_dir)
    q = db.query().fromTable("orders").where("o_orderkey % 7 == 0").join(db.query().fromTable("moved"), method="nested-loops", expr="o_orderdate == m_date and o_orderkey == m_orderkey")
    return db.optimize(q.select({"o_orderkey": ("o_orderkey", "long"), "day": ("m_date", "int")}).finalize(), "greedy").df()


def expressions_on_numbers(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("part").select({
        "p_partkey": ("p_partkey", "long"), "bits": ("(p_size & 12) | (p_partkey ^ 5)", "long"), "shifted": ("(p_size << 3) + (p_partkey >> 2)", "long"), "inverse": ("~p_size", "long"),
        "root": ("round(math.sqrt(p_retailprice), 3)", "double"), "down": ("math.floor(p_retailprice / 7)", "long"), "up": ("math.ceil(p_retailprice / 7)", "long"),
        "known": ("1 if p_name is not None else 0", "int"), "between": ("1 if 5 < p_size <= 20 else 0", "int"), "out": ("1 if p_size not in (1, 2, 3) else 0", "int"), "least": ("min(p_size, 25, p_partkey)", "long"), "power": ("p_size ** 3 % 11", "long"),
    })
    return q.finalize().df()


def expressions_on_texts(spark, sf_dir):
    q = opened(spark, sf_dir).query().fromTable("part").select({
        "p_partkey": ("p_partkey", "long"), "low": ("p_type.lower()", _text()), "begins": ("1 if p_type.startswith('S') else 0", "int"), "ends": ("1 if p_type.endswith('L') else 0", "int"),
        "at": ("p_type.find('A')", "long"), "many": ("p_type.count('A')", "long"), "swapped": ("p_type.replace('A', 'ou')", _text()), "length": ("len(p_name)", "long"), "part": ("p_brand[1:4]", _text(9)),
        "twice": ("p_brand * 2", _text()), "digits": ("1 if p_brand[-1:].isdigit() else 0", "int"), "first": ("p_brand.split('#')[0]", _text()), "number": ("int(str(p_size)) + 1", "long"),
    })
    return q.finalize().df()


def load_text(spark, sf_dir):
    """A pipe-separated file, read into a kept relation."""
    folder = scratch_folder(spark)
    opened(spark, sf_dir).df("supplier").selectExpr("concat_ws('|', s_suppkey, s_name, s_nationkey, s_acctbal, '1996-03-0' || (s_suppkey % 9 + 1)) as line").write.text(f"{folder}-text")
    db = Database(spark, folder)
    db.create_relation("supplier", [("s_suppkey", "long"), ("s_name", "char(25)"), ("s_nationkey", "int"), ("s_acctbal", "double"), ("s_since", "date")])
    db.load_text("supplier", f"{folder}-text")
    return db.query().fromTable("supplier").where("s_since >= 19960303").select({"s_suppkey": ("s_suppkey", "long"), "s_name": ("s_name", _text(25)), "s_acctbal": ("s_acctbal", "double"), "since": ("s_since", "int")}).finalize().df()


def kept_orders(spark, sf_dir, name="orders", index=("o_orderkey",)):
    db = Database(spark, scratch_folder(spark))
    db.create_relation("orders", [("o_orderkey", "long"), ("o_custkey", "long"), ("o_totalprice", "double"), ("o_orderdate", "date")])
    db.create_index("orders", list(index), primary=True)
    db.insert("orders", opened(spark, sf_dir).df("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return db


def primary_key_lookup(spark, sf_dir):
    return kept_orders(spark, sf_dir).lookup_by_key("orders", 77).select("o_orderkey", "o_custkey", "o_totalprice")


def header_scan(spark, sf_dir):
    """Rows by the files' own counts."""
    return kept_orders(spark, sf_dir).headers("orders").agg(F.sum("rows").cast("long").alias("rows"), F.min(F.col("bytes") > 0).alias("have_bytes"))


def scan_workload(spark, sf_dir):
    """Mode 1 of the read workload over two relations."""
    return spark.createDataFrame([(run_workload(opened(spark, sf_dir), ["orders", "lineitem"], 1).rows,)], "rows long")


def tuple_and_page_scan(spark, sf_dir):
    """A small relation row by row, and batch by batch."""
    db = opened(spark, sf_dir)
    by_row = sum(r["s_suppkey"] for r in db.tuples("supplier"))
    pages = list(db.pages("supplier"))
    return spark.createDataFrame([(by_row, sum(sum(b.column("s_suppkey").to_pylist()) for b in pages), sum(b.num_rows for b in pages))], "by_row long, by_page long, n long")


def drop_and_detach(spark, sf_dir):
    """A relation is detached and taken up again, another is dropped; what the catalog then knows, and the rows."""
    db = kept_orders(spark, sf_dir)
    db.create_relation("other", [("x", "int")])
    db.insert("other", [(1,), (2,)])
    db.remove_relation("orders", detach=True)
    gone = not db.has_relation("orders")
    db.attach_files("orders", [("o_orderkey", "long"), ("o_custkey", "long"), ("o_totalprice", "double"), ("o_orderdate", "date")])
    db.remove_relation("other")
    again = Database(spark, db.folder)
    size, files, rows = again.relation_stats("orders")
    return spark.createDataFrame([(gone, ",".join(again.relations()), rows, size > 0 and files > 0)], "gone boolean, relations string, n long, has_files boolean")


def tuple_id_rewrites(spark, sf_dir):
    """Rows are deleted and updated by their tuple ids."""
    db = kept_orders(spark, sf_dir)
    ids = lambda where: [tuple(r[0]) for r in db.with_tuple_ids("orders").where(where).select("tuple_id").collect()]
    db.delete_tuples("orders", ids("o_orderkey in (5, 6, 7)"))
    db.update_tuples("orders", ids("o_orderkey between 10 and 19"), {"o_totalprice": 1.5})
    return db.df("orders").select("o_orderkey", "o_totalprice")


def plan_estimates(spark, sf_dir):
    """Counted rows of the nodes of a plan, and those estimated from a whole sample."""
    db = opened(spark, sf_dir)
    q = db.query().fromTable("orders").where("o_totalprice > 50000").join(db.query().fromTable("customer"), method="block-nested-loops", expr="o_custkey == c_custkey").finalize()
    q.sample(1.0)
    rows = [(k, type(n).__name__, int(n.cardinality()), float(n.cardinality(estimated=True))) for k, (n, _) in enumerate(q.flatten())]
    return spark.createDataFrame(rows, "k int, node string, rows long, estimate double")


def stored_rewrites(spark, sf_dir):
    """Create, load, update by key and delete by key in a kept database; the rows that are there then."""
    db = Database(spark, scratch_folder(spark))
    source = opened(spark, sf_dir)
    db.create_relation("supplier", [("s_suppkey", "long"), ("s_name", "char(25)"), ("s_nationkey", "int"), ("s_acctbal", "double")])
    db.create_index("supplier", ["s_suppkey"], primary=True)
    db.insert("supplier", source.df("supplier"))
    db.update_by_key("supplier", [3], {"s_name": "renamed", "s_acctbal": -1.0})
    db.delete_by_key("supplier", 5)
    db.update_where("supplier", "s_nationkey == 7", {"s_acctbal": "s_acctbal + 1"})
    db.delete_where("supplier", "s_nationkey == 11 and s_acctbal < 0")
    return Database(spark, db.folder).df("supplier")


QUERIES = (
    scan, sampled_scan, where_and_or, project_expr, union_all, join_nl_theta, join_bnl_equi, join_hash, join_hash_residual, join_indexed, join_self_rename, cross, group_min_max,
    group_computed_key, group_multi_key, group_global_dummy, group_empty, group_max_init0, group_custom_fold, order_desc, date_int, tpch_q6, tpch_q14, tpch_q3, tpch_q10, tpch_q5,
    index_lookup, index_scan, random_point_reads, stored_rewrites, join_guarded, where_above_guarded, optimize_guarded, join_day_keys, join_day_expression, expressions_on_numbers, expressions_on_texts,
    load_text, primary_key_lookup, header_scan, scan_workload, tuple_and_page_scan, drop_and_detach, tuple_id_rewrites, plan_estimates,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {f"join_order_{p.replace('-', '_')}": _q5_by(p) for p in ("left-deep", "bushy", "greedy")}


_JOINED = "FROM orders, customer WHERE o_custkey = c_custkey"
_Q5 = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY n_name"""


_GUARDED = "SELECT l_orderkey, l_linenumber, c_custkey FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_linenumber > 2 AND c_nationkey < 10 AND 10 // (l_linenumber - 2) > 4 AND o_totalprice > 1000"
_DAYS = "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INTEGER AS day FROM orders WHERE o_orderkey % 7 = 0"


def oracle_sql() -> dict[str, str]:
    pairs = f"SELECT o_orderkey, c_custkey, c_nationkey {_JOINED}"
    return {
        "scan": "SELECT * FROM nation",
        "sampled_scan": "SELECT true AS share_holds, 0::BIGINT AS strange, 0::BIGINT AS changed, true AS seed_counts",
        "where_and_or": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity >= 49) AND NOT l_discount > 0.03 AND l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01'",
        "project_expr": "SELECT p_partkey, floor(-p_size / 2.0)::BIGINT AS halved, (((-p_size % 7) + 7) % 7)::BIGINT AS left_over, (p_size * p_size)::BIGINT AS squared, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, upper(p_brand) || '/' || right(p_brand, 2) AS brand, CASE WHEN contains(p_name, 'a') AND p_retailprice > 1000 THEN 1 ELSE 0 END AS dear, CASE WHEN p_size IN (1, 2, 3) THEN 1 ELSE 0 END AS size_in FROM part",
        "union_all": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem",
        "join_nl_theta": "SELECT * FROM nation JOIN region ON n_regionkey <= r_regionkey",
        "join_bnl_equi": pairs,
        "join_hash": pairs,
        "join_indexed": pairs,
        "join_hash_residual": f"{pairs} AND o_totalprice > c_acctbal * 10",
        "join_self_rename": "SELECT a.*, b.n_nationkey AS o_n_nationkey, b.n_name AS o_n_name, b.n_regionkey AS o_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "cross": "SELECT * FROM nation CROSS JOIN region",
        "group_min_max": "SELECT l_returnflag, min(l_quantity) AS min_quantity, greatest(0, max(l_extendedprice)) AS max_price FROM lineitem GROUP BY l_returnflag",
        "group_computed_key": "SELECT o_custkey % 10 AS k, length(o_orderpriority) AS urgent, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY 1, 2",
        "group_multi_key": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "group_global_dummy": "SELECT 1 AS dummy, round(sum(o_totalprice), 4) AS revenue FROM orders",
        "group_empty": "SELECT 1 AS dummy, 0.0::DOUBLE AS revenue WHERE false",
        "group_max_init0": "SELECT c_mktsegment, round(greatest(0, max(-c_acctbal - 5000)), 2) AS top FROM customer GROUP BY 1",
        "group_custom_fold": "SELECT c_mktsegment, list_sort(list(c_acctbal), 'DESC')[2] AS second FROM customer GROUP BY 1",
        "order_desc": "SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey, s_name, s_nationkey)::INTEGER AS place FROM supplier",
        "date_int": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INTEGER AS day FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199607' OR o_orderdate::DATE = '1997-01-01'",
        "tpch_q6": "SELECT 1 AS dummy, round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24",
        "tpch_q14": "SELECT 1 AS dummy, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= '1995-09-01' AND l_shipdate < '1995-10-01'",
        "tpch_q3": "SELECT l_orderkey, strftime(o_orderdate, '%Y%m%d')::INTEGER AS o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate::DATE > '1998-03-15' GROUP BY 1, 2",
        "tpch_q10": "SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM nation, customer, orders, lineitem WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= '1996-10-01' AND o_orderdate < '1997-01-01' AND l_returnflag = 'R' GROUP BY ALL",
        "tpch_q5": _Q5,
        "join_order_left_deep": _Q5,
        "join_order_bushy": _Q5,
        "join_order_greedy": _Q5,
        "index_lookup": "SELECT * FROM orders WHERE o_custkey = 7",
        "index_scan": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey",
        "random_point_reads": "SELECT count(*) AS reads, true AS a_fifth_at_random FROM orders",
        "join_guarded": "SELECT l_orderkey, l_linenumber FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_linenumber > 2 AND 10 // (l_linenumber - 2) > 4",
        "where_above_guarded": _GUARDED,
        "optimize_guarded": _GUARDED,
        "join_day_keys": _DAYS,
        "join_day_expression": _DAYS,
        "expressions_on_numbers": "SELECT p_partkey, ((p_size & 12) | xor(p_partkey, 5))::BIGINT AS bits, ((p_size << 3) + (p_partkey >> 2))::BIGINT AS shifted, (-p_size - 1)::BIGINT AS inverse, round(sqrt(p_retailprice), 3) AS root, floor(p_retailprice / 7)::BIGINT AS down, ceil(p_retailprice / 7)::BIGINT AS up, 1 AS known, (p_size > 5 AND p_size <= 20)::INTEGER AS between, (p_size NOT IN (1, 2, 3))::INTEGER AS out, least(p_size, 25, p_partkey)::BIGINT AS least, ((p_size::BIGINT * p_size * p_size) % 11)::BIGINT AS power FROM part",
        "expressions_on_texts": "SELECT p_partkey, lower(p_type) AS low, starts_with(p_type, 'S')::INTEGER AS begins, ends_with(p_type, 'L')::INTEGER AS ends, (strpos(p_type, 'A') - 1)::BIGINT AS at, (length(p_type) - length(replace(p_type, 'A', '')))::BIGINT AS many, replace(p_type, 'A', 'ou') AS swapped, length(p_name)::BIGINT AS length, substr(p_brand, 2, 3) AS part, p_brand || p_brand AS twice, regexp_matches(p_brand, '[0-9]$')::INTEGER AS digits, split_part(p_brand, '#', 1) AS first, (p_size + 1)::BIGINT AS number FROM part",
        "load_text": "SELECT s_suppkey, s_name, s_acctbal, (19960301 + s_suppkey % 9)::INTEGER AS since FROM supplier WHERE s_suppkey % 9 >= 2",
        "primary_key_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77",
        "header_scan": "SELECT count(*) AS rows, true AS have_bytes FROM orders",
        "scan_workload": "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS rows",
        "tuple_and_page_scan": "SELECT sum(s_suppkey)::BIGINT AS by_row, sum(s_suppkey)::BIGINT AS by_page, count(*) AS n FROM supplier",
        "drop_and_detach": "SELECT true AS gone, 'orders' AS relations, count(*) AS n, true AS has_files FROM orders",
        "tuple_id_rewrites": "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 10 AND 19 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey NOT IN (5, 6, 7)",
        "plan_estimates": "WITH o AS (SELECT count(*) AS n FROM orders), w AS (SELECT count(*) AS n FROM orders WHERE o_totalprice > 50000), c AS (SELECT count(*) AS n FROM customer), j AS (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000) SELECT * FROM (SELECT 0 AS k, 'Join' AS node, n AS rows, n::DOUBLE AS estimate FROM j UNION ALL SELECT 1, 'TableScan', n, n::DOUBLE FROM c UNION ALL SELECT 2, 'Select', n, n::DOUBLE FROM w UNION ALL SELECT 3, 'TableScan', n, n::DOUBLE FROM o)",
        "stored_rewrites": "WITH a AS (SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey = 3 THEN -1.0 ELSE s_acctbal END + CASE WHEN s_nationkey = 7 THEN 1 ELSE 0 END AS s_acctbal FROM supplier WHERE s_suppkey <> 5) SELECT * FROM a WHERE NOT (s_nationkey = 11 AND s_acctbal < 0)",
    }
