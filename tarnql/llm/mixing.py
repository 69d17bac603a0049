"""Mixing sources to target weights.

Every document gets a hash-random key, the MD5 of its id. A source's budget is a number of whole epochs and a rest; the
rest is cut in the order of the keys. The order is found by range: a source's rows are dealt to bins by the leading
digits of the key, the bins' sizes are summed up in order, and inside a bin the rows are sorted and summed up from
where the bin begins. A bin holds about the square root of a source's rows whatever the source's share, so no
source gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import forget, word_count, written

DIGITS = 12  # hexadecimal digits of the key that bins are taken from
BROADCAST_SOURCES = 50_000  # up to so many sources (some 100 bytes each) are joined by broadcast
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budgets of all sources.

    Sources by code point, null last, have the weights in turn. Together they get share of all sizes by weight, but
    none more than most times its size; what is above is given to the others by weight, until none is above.
    In the order of size by weight, the sources that are capped come first: one pass of running sums
    finds how many. The table has one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_ = W.partitionBy()
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight_left).withColumn("open", F.col("ratio") > F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(all_)["level"]
    return t.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _bin(key: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("long"), 4 * DIGITS - bits)


def _by_source(rows: DataFrame, per_source: DataFrame, name: str, sources: int) -> DataFrame:
    """rows with the columns of their source's row in per_source (its source is the column called name); a hot source isn't gathered."""
    same = rows["_source"].eqNullSafe(per_source[name])
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), same).drop(name)
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt_of", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["_source"].eqNullSafe(salted[name]) & (F.col("_salt_of") == F.col("_salt"))).drop("_salt", "_salt_of", name)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *columns) -> DataFrame:
    """Each row's source, size and key, and some columns more."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("_size"), key.alias("_key"), *columns)


def _plan(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, int, int]:
    """For each source its size, target, whole epochs, and where the cut of its rest is; the bits of a bin, and the number of sources.

    rows: (_source, _size, _key), a written table.
    """
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    largest, sources = totals.agg(F.max("rows"), F.count("*")).first()
    bits = min(4 * DIGITS, max(0, (largest or 1).bit_length() + 1) // 2)
    targets = source_targets(totals.select(F.col("_source").alias("source"), "source_size"), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    targets = written(targets.withColumn("full", times).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "targets")

    bins = rows.groupBy("_source", _bin(F.col("_key"), bits).alias("b")).agg(F.sum("_size").alias("n"))
    bins = bins.withColumn("begin", F.sum("n").over(W.partitionBy("_source").orderBy("b")) - F.col("n")).withColumnRenamed("_source", "s")
    cut = bins.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")))
    cut = cut.where((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("n") >= F.col("rest"))).select("s", "b", "begin", "rest")
    cut = written(cut, "cuts")  # at most a row for each source

    # in the one bin of each source that holds its cut, the last key that is still taken
    here = _by_source(rows, cut, "s", sources).where(_bin(F.col("_key"), bits) == F.col("b"))
    end = F.sum("_size").over(W.partitionBy("_source").orderBy("_key", "_size").rowsBetween(W.unboundedPreceding, 0)) + F.col("begin")
    here = here.withColumn("end", end).where(F.abs(F.col("end") - F.col("rest")) < F.abs(F.col("end") - F.col("_size") - F.col("rest")))
    last = here.groupBy(F.col("_source").alias("s")).agg(F.max(F.struct("_key", "_size")).alias("last"))
    plan = targets.join(last, targets.source.eqNullSafe(last.s), "left").drop("s")
    plan = plan.join(cut.select("s", F.col("b").alias("cut_bin")), targets.source.eqNullSafe(F.col("s")), "left")
    columns = [F.col(c).alias(f"_{c}") for c in ("source_size", "target", "full", "last", "cut_bin")]
    return written(plan.select(F.col("source").alias("_of"), *columns), "plan"), bits, sources


def _epochs(bits: int) -> Column:
    """How often a row with its source's plan is taken."""
    more = F.when(F.col("_cut_bin").isNull(), False).when(F.col("_last").isNull(), _bin(F.col("_key"), bits) < F.col("_cut_bin")).otherwise(F.struct("_key", "_size") <= F.col("_last"))
    return F.col("_full") + more.cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: the id, source, size (words), source_size, target, epochs (how often it is taken) and taken (words).

    A source's documents are each taken floor(target / source_size) times, and once more in the order of their keys
    while that brings the source's words nearer to its target; so the words differ from the target by at most half of
    one document. Null texts and texts without words have size 0; a null source is a source of its own. Rows of one
    key (repeated rows, null ids) come in the order of their sizes, and of those with equal sizes all or none are taken. A source without words has
    the target 0, and its (wordless) documents are taken once. Empty tables give no rows. Other columns are not looked at.
    """
    rows = written(_keyed(docs, id_col, text_col, source_col, F.col(id_col).alias("id")), "sizes")
    plan, bits, sources = _plan(rows, weights, share, most)
    out = _by_source(rows, plan, "_of", sources).withColumn("epochs", _epochs(bits))
    return out.select(F.col("id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "epochs", (F.col("_size") * F.col("epochs")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources takes it, with its own columns, whatever their names.

    Null and empty texts, null sources and ids, repeated rows and empty tables are taken as mix_sources says; rows of one id and one
    size are taken alike. A row is repeated whole, and its copies are equal.
    """
    sizes = written(_keyed(docs, id_col, text_col, source_col), "sizes")
    plan, bits, sources = _plan(sizes, weights, share, most)
    forget(sizes)
    keyed = _keyed(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = _by_source(keyed, plan, "_of", sources).select("_row", F.explode(F.array_repeat(F.lit(1), _epochs(bits).cast("int"))))
    return out.select("_row.*")
