"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments of equal length. With segment means m and deviations s, the squared distance of two
vectors is at least sum L * ((m - m')^2 + (s - s')^2), so with their lengths known their inner product is at most
sum L * (m * m' + s * s'). The sums are inner products of short feature vectors.

Vectors are dealt to cells by their coarsest features: the nearest of some pivots. A cell is known by the box of its vectors' finest features,
which bounds the inner product of a query with any of them. A query first goes to the cell with the highest bound; the
k-th best score it gets there is its threshold, and then it goes to those other cells whose bound is not below that. In
a cell the coarsest features bound all pairs and pick vectors whose exact scores raise the threshold; what the bound leaves is bounded
again by finer features, and exact scores are computed for what is left then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._vectors import EVERY, best_rows, finite_rows, fold_copies, matrix, merge_best

LEVELS = (4, 16)  # segments, coarse to fine
BLOCK = 16384  # queries or vectors that meet in one task at most
CELL, CELLS = 2048, 1024  # vectors of a cell, about, while there are fewer cells than this
PIVOTS = 4096  # vectors of which the pivots are made, at most
EXACT = 1 << 53
WIDE = (1 << 63) - 1
KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def _integers(scale: float):
    """(id, vector) to (id, dim, v): floor(scale * x), as bytes of the narrowest of three kinds of integer."""

    def run(batches):
        for b in batches:
            ids, dims, cells = [], [], []
            for k, x in finite_rows(b, 1):
                x = np.floor(scale * x)
                top = np.abs(x).max(initial=0)
                if not top < 2.0**63:
                    continue
                kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
                ids.append(b.column(0)[k].as_py()), dims.append(len(x)), cells.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(cells, pa.binary())], ["id", "dim", "v"])

    return run


def _vectors(cells: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of one dim as int64; those without components get one, 0."""
    x = [np.frombuffer(c, KINDS[len(c) // dim]).astype(np.int64) if dim else np.zeros(1, np.int64) for c in cells]
    return np.array(x, np.int64).reshape(len(cells), max(dim, 1))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of the length; inner products of these bound those of the rows."""
    length = -(-x.shape[1] // segments)
    x = np.pad(x, ((0, 0), (0, length * segments - x.shape[1]))).reshape(len(x), segments, length)
    return np.sqrt(length) * np.concatenate((x.mean(2), x.std(2)), 1)


def search_block(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, levels=LEVELS, floor: np.ndarray | None = None):
    """For each query the ids and scores of its k best vectors with other ids than its own; of those below its floor, if it has one, some may be missing."""
    if not q.shape[1]:
        q, v = np.zeros((len(q), 1), np.int64), np.zeros((len(v), 1), np.int64)
    top = lambda x: int(max(x.max(initial=0), -x.min(initial=0)))
    if top(q) * top(v) * q.shape[1] >= EXACT:  # beyond doubles: Python's integers, all pairs
        for i, a in zip(q_ids, q.astype(object)):
            score = np.array([max(-WIDE, min(WIDE, x)) for x in (v.astype(object) @ a).tolist()], np.int64)
            other = np.flatnonzero(v_ids != i)
            at = other[best_rows(score[other], v_ids[other], k)] if len(other) else other
            yield i, v_ids[at], score[at]
        return
    q, v = q.astype(np.float64), v.astype(np.float64)
    fq, fv = [segment_features(q, s) for s in levels], [segment_features(v, s) for s in levels]
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0))
    for a in range(0, len(q), 256):
        coarse = fq[0][a : a + 256] @ fv[0].T
        for j in range(len(coarse)):
            i = a + j
            bound, mine = coarse[j], v_ids != q_ids[i]
            m = min(len(v), 4 * k + 1)
            seed = np.argpartition(bound, len(v) - m)[len(v) - m :]
            seed = seed[mine[seed]]
            exact = np.sort(v[seed] @ q[i])
            least = exact[-k] - slack[i] if len(exact) >= k else -np.inf
            if floor is not None:
                least = max(least, floor[i] - slack[i])
            left = np.flatnonzero((bound >= least) & mine)
            for f, g in zip(fq[1:], fv[1:]):
                left = left[g[left] @ f[i] >= least]
            score = v[left] @ q[i]
            at = best_rows(score, v_ids[left], k)
            yield q_ids[i], v_ids[left[at]], score[at].astype(np.int64)


def _task(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            dim = queries["dim"][0].as_py()
            of = [(t["id"].to_numpy(), _vectors(t["v"].to_pylist(), dim)) for t in (queries, vectors)]
            floor = pc.fill_null(queries["floor"].cast(pa.float64()), -np.inf).to_numpy()
            for i, ids, scores in search_block(*of[0], *of[1], k, floor=floor):
                out[0] += [int(i)] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    return run


def _by_dim(batches):
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            yield int(dim), part, _vectors(part.column(2).to_pylist(), int(dim)).astype(np.float64)


def _pivots(known: DataFrame) -> dict[int, np.ndarray]:
    """For each dim of a bounded sample the coarsest features of some vectors, so many that cells have about CELL vectors."""
    sizes = {r["dim"]: r["n"] for r in known.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(CELLS).collect()}
    some = known.select("id", "dim", "v", F.xxhash64("id", F.lit(5)).alias("h")).orderBy("h", "id", "v").limit(PIVOTS).collect()
    out = {}
    for dim, n in sizes.items():
        mine = _vectors([r["v"] for r in some if r["dim"] == dim], dim).astype(np.float64)
        if len(mine):
            out[dim] = np.unique(segment_features(mine, LEVELS[0]), axis=0)[: max(1, min(CELLS, n // CELL))] if n // CELL < 2 else _spread(segment_features(mine, LEVELS[0]), min(CELLS, n // CELL))
    return out


def _spread(x: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Centres of many groups of rows (Lloyd's rounds, beginning with the first rows)."""
    centres = np.unique(x, axis=0)
    centres = centres[np.random.Generator(np.random.PCG64(1)).permutation(len(centres))[:many]]
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _celled(pivots: dict[int, np.ndarray]):
    """(id, dim, v) to (id, dim, v, cell); vectors of a dim without pivots share the cell 0."""

    def run(batches):
        for dim, part, x in _by_dim(batches):
            cell = _nearest(segment_features(x, LEVELS[0]), pivots[dim]) if dim in pivots else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], ["id", "dim", "v", "cell"])

    return run


BOX = 2 * LEVELS[-1]
BOX_COLUMNS = [f"lo{k}" for k in range(BOX)] + [f"hi{k}" for k in range(BOX)] + ["norm"]


def _boxes(batches):
    """Of each batch and cell the vectors, the box of their finest features, and the greatest length."""
    for b in batches:
        for dim, part, x in _by_dim([b]):
            f, cell = segment_features(x, LEVELS[-1]), part.column(3).to_numpy()
            for c in np.unique(cell):
                mine = f[cell == c]
                row = [dim, int(c), len(mine), *mine.min(0).tolist(), *mine.max(0).tolist(), float(np.linalg.norm(x[cell == c], axis=1).max())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * (2 * BOX + 1)])], ["dim", "cell", "n", *BOX_COLUMNS])


def _bounds(cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, first: bool):
    """Queries (id, dim, v, floor) to the cells they go to: at first those with the highest bounds that have more than k vectors together; then the others
    whose bound is not below the floor. Queries of a dim without boxes go to its one cell at first."""

    def choose(dim, x, floor):
        names, boxes, n = cells[dim]
        f, lo, hi, norm = segment_features(x, LEVELS[-1]), boxes[:, :BOX], boxes[:, BOX:-1], boxes[:, -1]
        up, down = np.maximum(f, 0), np.minimum(f, 0)
        bound = up @ hi.T + down @ lo.T + 1e-9 * (1 + np.linalg.norm(x, axis=1)[:, None] * norm)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        start = np.zeros(bound.shape, bool)
        np.put_along_axis(start, order, before <= k, axis=1)
        return names, start if first else ~start & (bound >= floor[:, None])

    def run(batches):
        for b in batches:
            floors = pc.fill_null(b.column(3).cast(pa.float64()), -np.inf).to_numpy(zero_copy_only=False)
            floors = np.where(floors <= -float(WIDE), -np.inf, floors)  # scores are held at their ends
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                if int(dim) in cells:
                    names, go = choose(int(dim), _vectors(part.column(2).to_pylist(), int(dim)).astype(np.float64), floors[at])
                else:
                    names, go = np.zeros(1, np.int32), np.full((len(at), 1), first)
                i, c = np.nonzero(go)
                again = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(names[c].astype(np.int32))], ["id", "dim", "v", "floor", "cell"])

    return run


def _met(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Queries and vectors of one cell meet, in tasks of at most about BLOCK of either."""
    at = ["dim", "cell"]
    many = lambda df, n: df.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    parts = many(known, "parts").join(many(asked, "sides"), at)
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, at).select("id", "v", "floor", *at, dealt("sides").alias("side"), all_("parts").alias("part"))
    right = known.join(parts, at).select("id", "v", *at, dealt("parts").alias("part"), all_("sides").alias("side"))
    key = [*at, "part", "side"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_task(k), "query_id long, vec_id long, score long")


def top_k_inner(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, queries=None, report: dict | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query row's k highest integer inner products over all other rows, ties to the smaller id.

    Components x count as floor(scale * x). queries: a condition on the column id, by default ids that 50 divides. Rows with
    a null id, and vectors that are null or hold a null, NaN, infinite or (scaled) component beyond 64 bits take no part (the last has no place in a score of 64 bits); vectors are only compared
    with those of as many components. Empty vectors have the score 0 with each other. Repeated rows count once, as do
    several vectors of one id, with their best score. Scores beyond 64 bits are held at their ends. An empty table gives no rows.

    A query goes to the cells that its bounds leave; on vectors without any structure these are all. Of equal vectors only the k + 1 smallest ids
    are searched, since no others can be among the best. report gets the number of cells and of (query, cell) pairs that were exchanged.
    """
    numbers = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(_integers(scale), "id long, dim int, v binary")
    numbers = written(numbers.distinct(), "integers")
    asked = numbers.where(F.pmod("id", F.lit(EVERY)) == 0 if queries is None else queries)
    folded = fold_copies(numbers, k + 1)
    pivots = _pivots(numbers)
    known = written(folded.mapInArrow(_celled(pivots), "id long, dim int, v binary, cell int"), "vectors")
    sized = known.where(F.col("dim").isin(sorted(pivots))) if pivots else known.limit(0)
    boxes = sized.mapInArrow(_boxes, "dim int, cell int, n long, " + ", ".join(f"{c} double" for c in BOX_COLUMNS))
    boxes = boxes.groupBy("dim", "cell").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in BOX_COLUMNS))
    cells: dict[int, list] = {}
    for r in boxes.orderBy("dim", "cell").collect():  # at most PIVOTS + CELLS rows
        cells.setdefault(r["dim"], []).append(r)
    packed = {dim: (np.array([r["cell"] for r in rows]), np.array([list(r)[3:] for r in rows], float), np.array([r["n"] for r in rows])) for dim, rows in cells.items()}
    schema = "id long, dim int, v binary, floor long, cell int"
    one = asked.withColumn("floor", F.lit(None).cast("long")).mapInArrow(_bounds(packed, k, True), schema)
    found = written(merge_best(_met(one, known, k), k), "first-cells")
    floor = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = asked.join(floor, "id", "left").select("id", "dim", "v", "floor").mapInArrow(_bounds(packed, k, False), schema)
    if report is not None:
        report |= {"cells": sum(map(len, cells.values())), "queries": asked.count(), "pairs": one.count() + rest.count()}
    more = _met(rest, known, k)
    return merge_best(found.select("query_id", "vec_id", "score").unionByName(more), k)
