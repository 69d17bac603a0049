"""Vectors in Arrow columns, and what exact and approximate search share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EVERY = 50  # rows whose id this divides are queries, unless a caller names others


def finite_rows(batch: pa.RecordBatch, column: int):
    """Row numbers and vectors (float64 arrays) of the rows that have an id and a vector of finite numbers."""
    ids, cells = batch.column(0), batch.column(column)
    offsets, flat = cells.offsets.to_numpy(), cells.values.cast(pa.float64())
    flat = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    good = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = (good[offsets[1:]] == good[offsets[:-1]]) & cells.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(ok):
        yield int(k), flat[offsets[k] : offsets[k + 1]]


def fold_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Of (id, dim, v) rows with the same dim and v those with the keep smallest ids: no others can be among a query's keep - 1 nearest.

    The limit is applied before rows are exchanged, so that a vector with very many copies does not gather.
    """
    rank = F.row_number().over(W.partitionBy("dim", "v").orderBy("id"))
    return vectors.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, highest first."""
    if len(score) > 4 * k:
        bound = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= bound)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """Of rows (query_id, vec_id, score) the k best of each query with ranks from 1; a vec_id found several times counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
