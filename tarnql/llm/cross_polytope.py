"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded to a power of two, is turned by three rounds of random signs and fast Hadamard transforms; its
hash is the nearest signed axis, and with it the nearest of the first axes of a second such rotation, of as many as give
buckets for the table's size. Each of several tables has rotations of its own. A query looks into the buckets of the axes
nearest to it in every table (multiprobe). In the exchange a vector is a byte a component, with a bound on what that loses:
in its cells a query's candidates get a least and a greatest possible cosine, and only those whose greatest is not below the
k-th best least of all cells are fetched once and ranked by the exact cosine of the original vectors. Among many near copies
these bounds tell too few apart: a query with a crowd of candidates in a cell gives no pairs for them but the names of their buckets
in the first table, and meets the original vectors there, each of which is sent once and not once a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import written
from ._vectors import EVERY, best_rows, finite_rows, fold_copies, matrix, merge_best

ROUNDS = 3
CELL = 8192  # vectors, and queries, of one cell, about
SHARE, FALL = 0.1, 0.16  # of the buckets, what a query looks into: SHARE / n ** FALL
PROBES = 48  # buckets a query should look into in a table; buckets are made so many that this is their share
SLACK = 1e-6  # over the bound, for rounding
CROWD = 8  # times k: more candidates than that of a query in a bucket or cell are ranked where they lie


def signs(dim: int, tables: int, depth: int, seed: int) -> np.ndarray:
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.Generator(np.random.PCG64([seed, dim])).choice(np.array([-1.0, 1.0]), (tables, depth, ROUNDS, width))


def rotate(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of each row: for each round, signs and a fast Hadamard transform."""
    n = len(x)
    x = np.pad(x, ((0, 0), (0, rounds.shape[1] - x.shape[1])))
    for sign in rounds:
        x, h = x * sign, 1
        while h < x.shape[1]:
            y = x.reshape(n, -1, 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def bucket_plan(n: int, dim: int) -> tuple[int, int]:
    """For n vectors of dim components: axes of the second rotation that count (0: none), and the buckets that a query looks into in each table.

    The share of buckets falls with n, so vectors that are compared to a query grow slower than n.
    """
    width = 1 << max(0, dim - 1).bit_length()
    share = SHARE / max(n, 1) ** FALL
    axes = 0
    while 2 * width * max(1, 2 * axes) * share < PROBES and axes < width:
        axes = axes * 2 or 1
    return axes, max(1, int(np.ceil(share * 2 * width * max(1, 2 * axes))))


def nearest_buckets(x: np.ndarray, rotations: np.ndarray, axes: int, probes: int) -> np.ndarray:
    """For each row of unit vectors its probes nearest buckets in one table, nearest first. A bucket is the number of a
    signed axis (2 * axis, + 1 if negative) of the first rotation and one of the first axes of the second."""
    y = rotate(x, rotations[0])
    score = np.stack((y, -y), 2).reshape(len(x), -1)
    if axes:
        z = rotate(x, rotations[1])[:, :axes]
        z = np.stack((z, -z), 2).reshape(len(x), -1)
        if probes == 1:  # the nearest of both
            return (score.argmax(1) * (2 * axes) + z.argmax(1))[:, None]
        score = (score[:, :, None] + z[:, None]).reshape(len(x), -1)
    if probes < score.shape[1]:
        top = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
    else:
        top = np.tile(np.arange(score.shape[1]), (len(x), 1))
    order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large numbers are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parts_of(batches):
    """(id, dim, n, v) by dim: the dim, its vectors in all, the rows, and the unit vectors."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            yield int(dim), part.column(2)[0].as_py(), part, units(matrix(part.column(3), np.float64))


def _index(tables: int, seed: int):
    """(id, dim, n, v) to (id, dim, tbl, bucket, home, c, scale, err): a row for each table, with the bucket in the first one, the unit vector in bytes and the length of what these lose."""

    def run(batches):
        for dim, n, part, x in _parts_of(batches):
            axes, _ = bucket_plan(n, dim)
            scale = np.abs(x).max(1) / 127
            c = np.rint(x / scale[:, None]).astype(np.int8)
            err = np.linalg.norm(x - c * scale[:, None], axis=1)
            packed = pa.array([r.tobytes() for r in c], pa.binary())
            for t, rotations in enumerate(signs(dim, tables, 2, seed)):
                bucket = nearest_buckets(x, rotations, axes, 1)[:, 0]
                home = bucket if t == 0 else home
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(bucket, pa.int64()), pa.array(home, pa.int64()), packed, pa.array(scale), pa.array(err)], ["id", "dim", "tbl", "bucket", "home", "c", "scale", "err"])

    return run


def _probes(tables: int, seed: int, probes: int | None):
    """(id, dim, n, v) to (id, dim, tbl, buckets): what a query looks into."""

    def run(batches):
        for dim, n, part, x in _parts_of(batches):
            axes, many = bucket_plan(n, dim)
            for t, rotations in enumerate(signs(dim, tables, 2, seed)):
                code = nearest_buckets(x, rotations, axes, probes or many)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(list(code.astype(np.int64)), pa.list_(pa.int64()))], ["id", "dim", "tbl", "buckets"])

    return run


def _doubles(batches):
    for b in batches:
        got = [(b.column(0)[k].as_py(), len(x), x.tobytes()) for k, x in finite_rows(b, 1) if x.any()]
        ids, dims, cells = zip(*got) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(cells, pa.binary())], ["id", "dim", "v"])


def cosine_rows(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of q and each row of v in doubles; equal rows give equal results."""
    q, v = q / np.abs(q).max(), v / np.abs(v).max(1, keepdims=True)
    return (v * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


#: What a cell gives: pairs (query_id, vec_id, low, high, dim); a query's crowds (query_id, high, dim, home); vectors of crowds (vec_id, dim, home).
BOUNDS = "query_id long, vec_id long, low double, high double, dim int, home long"


def _bounded(k: int):
    """One cell: for each query the vectors of its buckets whose cosine can be among its k best here, with bounds.

    If these are a crowd, only the k of greatest low are pairs. For the others there is a row for each query and home, with the greatest high,
    and one for each vector, so the rows are at most in proportion to the queries' buckets and the vectors.
    """

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and vectors.num_rows:
            bucket, home = vectors["bucket"].to_numpy(), vectors["home"].to_numpy()
            order = np.lexsort((home, bucket))
            bucket, home, ids, scale, err = (vectors[c].to_numpy()[order] for c in ("bucket", "home", "id", "scale", "err"))
            c = matrix(vectors["c"], np.int8)[order].astype(np.float32)
            q_ids, q = queries["id"].to_numpy(), matrix(queries["v"], np.float32)
            asked = queries["buckets"].combine_chunks()
            who = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy()))
            wanted = asked.flatten().to_numpy()
            by = np.argsort(wanted, kind="stable")
            who, wanted = who[by], wanted[by]
            names, first = np.unique(wanted, return_index=True)
            found, crowds, crowded = [], [], np.zeros(len(ids), bool)
            for b, s, e in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(wanted)]):
                lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
                for at in range(s, e, 512):
                    mine = who[at : min(e, at + 512)]
                    about = q[mine] @ c[lo:hi].T * scale[lo:hi]
                    low = np.where(q_ids[mine, None] == ids[None, lo:hi], -np.inf, about - err[lo:hi] - SLACK)
                    keep = low > -np.inf
                    if hi - lo > k:  # what cannot be among the k best of this bucket need not be kept
                        least = np.partition(low, hi - lo - k, axis=1)[:, hi - lo - k, None]
                        keep &= about + err[lo:hi] + SLACK >= least
                    many = np.flatnonzero(keep.sum(1) > CROWD * k)
                    if len(many):
                        rest = keep[many]
                        top = np.argpartition(-low[many], k - 1, axis=1)[:, :k]
                        np.put_along_axis(rest, top, False, 1)
                        keep[many] &= ~rest
                        crowded[lo:hi] |= rest.any(0)
                        homes, start = np.unique(home[lo:hi], return_index=True)
                        high = np.maximum.reduceat(np.where(rest, about[many] + err[lo:hi] + SLACK, -np.inf), start, axis=1)
                        i, j = np.nonzero(high > -np.inf)
                        crowds.append((mine[many[i]], homes[j], high[i, j]))
                    i, j = np.nonzero(keep)
                    found.append((mine[i], lo + j, low[i, j]))
            w, j, low = (np.concatenate(x) for x in zip(*found)) if found else (who[:0], who[:0], scale[:0])
            order = np.lexsort((-low, w))
            w, j, low = w[order], j[order], low[order]
            starts = np.searchsorted(w, np.arange(len(q)))
            last = np.minimum(starts + k, np.searchsorted(w, np.arange(len(q)), "right")) - 1
            full = last - starts + 1 >= k
            least = np.where(full, low[np.maximum(last, 0)] if len(low) else -np.inf, -np.inf)
            high = low + 2 * (err[j] + SLACK)
            keep = high >= least[w]
            w, j, low, high = w[keep], j[keep], low[keep], high[keep]
            start = np.searchsorted(w, w)  # the same for buckets that are no crowds each
            rest = (np.searchsorted(w, w, "right") - start > CROWD * k) & (np.arange(len(w)) - start >= k)
            crowded[j[rest]] = True
            crowds.append((w[rest], home[j[rest]], high[rest]))
            w, j, low, high = w[~rest], j[~rest], low[~rest], high[~rest]
            c_w, c_home, c_high = (np.concatenate(x) for x in zip(*crowds))
            there = c_high >= least[c_w]
            met = pa.table({"w": c_w[there], "home": c_home[there], "high": c_high[there]}).group_by(["w", "home"]).aggregate([("high", "max")])
            v = np.flatnonzero(crowded & np.isin(home, met["home"].to_numpy()))
            dim = queries["dim"][0].as_py()
            out = [
                {"query_id": q_ids[w], "vec_id": ids[j], "low": low, "high": high, "dim": np.full(len(w), dim)},
                {"query_id": q_ids[met["w"].to_numpy()], "high": met["high_max"].to_numpy(), "dim": np.full(len(met), dim), "home": met["home"].to_numpy()},
                {"vec_id": ids[v], "dim": np.full(len(v), dim), "home": home[v]},
            ]
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("dim", pa.int32()), ("home", pa.int64())])
        whole = lambda x: pa.table([pa.array(x[f.name], f.type) if f.name in x else pa.nulls(len(x["dim"]), f.type) for f in schema], schema)
        return pa.concat_tables([whole(x) for x in out]) if out else schema.empty_table()

    return run


def _ranked(k: int):
    """Queries (query_id, q) and vectors (vec_id, v) of one home bucket's part: each query's k nearest by the exact cosine (query_id, vec_id, score). An id counts once."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            ids = vectors["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], matrix(vectors["v"], np.float64)[order]
            q_ids, q = queries["query_id"].to_numpy(), matrix(queries["q"], np.float64)
            names, first = np.unique(ids, return_index=True)
            unit = units(v)
            for at in range(0, len(q), 512):
                about = units(q[at : at + 512]) @ unit.T
                about[q_ids[at : at + 512, None] == ids] = -np.inf
                bound = np.full(len(about), -np.inf)
                if len(names) > k:
                    bound = np.partition(np.maximum.reduceat(about, first, axis=1), len(names) - k, axis=1)[:, len(names) - k]
                for r, (near, least) in enumerate(zip(about, bound), at):
                    some = np.flatnonzero((near > -np.inf) & (near >= least - 1e-9))  # rounding
                    score = cosine_rows(q[r], v[some])
                    order = np.lexsort((ids[some], -score))
                    order = order[np.sort(np.unique(ids[some][order], return_index=True)[1])[:k]]
                    for to, x in zip(out, (np.full(len(order), q_ids[r]), ids[some][order], score[order])):
                        to.append(x)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.float64()))})

    return run


def _exact(batches):
    for b in batches:
        score = [cosine_rows(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)[None])[0] for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _singles(batches):
    """(id, dim, n, v) to (id, dim, v): unit vectors in single precision; SLACK covers what that loses."""
    for _, _, part, x in _parts_of(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["id", "dim", "v"])


def _bounds(index: DataFrame, probed: DataFrame, singles: DataFrame, k: int, groups: int) -> DataFrame:
    """Candidates with bounds. Small buckets of a table share a cell with others; one of many vectors is dealt to cells of its own, and its queries as well."""
    at = ["dim", "tbl", "bucket"]
    each = probed.select("id", "dim", "tbl", F.explode("buckets").alias("bucket"))
    sizes = index.groupBy(*at).agg(F.count("*").alias("n")).join(each.groupBy(*at).agg(F.count("*").alias("m")), at)  # buckets that a query looks into
    parts = sizes.select(*at, F.ceil(F.col("n") / CELL).cast("int").alias("parts"), F.ceil(F.col("m") / CELL).cast("int").alias("sides"))
    parts = written(parts, "bucket-parts")
    alone = (F.col("parts") > 1) | (F.col("sides") > 1)
    cell: Column = F.when(alone, -F.col("bucket") - 1).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = index.join(parts, at).select("id", "c", "scale", "err", "home", *at, cell.alias("cell"), dealt("parts").alias("part"), all_("sides").alias("side"))
    left = each.join(parts, at).select("id", *at, cell.alias("cell"), dealt("sides").alias("side"), all_("parts").alias("part"))
    key = ["dim", "tbl", "cell", "part", "side"]
    left = left.groupBy("id", *key).agg(F.collect_list("bucket").alias("buckets")).join(singles, ["id", "dim"])  # as many as a query's probes at most
    left = left.select("id", "v", "buckets", *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_bounded(k), BOUNDS)


def _crowds(found: DataFrame, fetch: Callable[[DataFrame, str, str], DataFrame], k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query's crowds the k nearest of every part. A home of many vectors or queries is dealt as buckets are."""
    at = ["dim", "home"]
    asked = found.where("query_id is not null and vec_id is null").select("query_id", *at).distinct()
    crowd = found.where("query_id is null").select("vec_id", *at).distinct()
    sizes = crowd.groupBy(*at).agg(F.count("*").alias("n")).join(asked.groupBy(*at).agg(F.count("*").alias("m")), at)
    parts = written(sizes.select(*at, F.ceil(F.col("n") / CELL).cast("int").alias("parts"), F.ceil(F.col("m") / CELL).cast("int").alias("sides")), "crowd-parts")
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = [*at, "part", "side"]
    right = crowd.join(parts, at).select("vec_id", *at, dealt("vec_id", "parts").alias("part"), all_("sides").alias("side"))
    left = asked.join(parts, at).select("query_id", *at, dealt("query_id", "sides").alias("side"), all_("parts").alias("part"))
    own = lambda df, *names: df.select(*(F.col(c).alias(c) for c in (*names, *key)))  # noqa: E731  columns of their own, for the cogroup
    left, right = own(fetch(left, "query_id", "q"), "query_id", "q"), own(fetch(right, "vec_id", "v"), "vec_id", "v")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_ranked(k), "query_id long, vec_id long, score double")


def nearest_cosine(vectors: DataFrame, k: int = 5, tables: int = 10, probes: int | None = None, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", queries=None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query row's k nearest of the rows found, by cosine, ties to the smaller id.

    queries: a condition on the column id, by default ids that 50 divides; candidates are all rows but the query's own. Rows with a null id,
    and vectors that are null, zero, empty or hold a null, NaN or infinite component take no part; vectors only meet those of as many
    components. Repeated rows count once, as do several vectors of one id, with their best score. An empty table gives no rows.

    Every row is indexed in every table. The buckets, and the share of them that a query looks into, follow from the number of vectors of a
    dim (bucket_plan); probes sets a number instead. A query that finds fewer than k that way looks into all buckets of one table, so it gets k
    if there are so many. Of equal vectors the k + 1 smallest ids are indexed, since no others can be among the nearest; a bucket
    of many vectors or queries is dealt to several cells, and none is capped. Where many vectors are nearly the same, a cell
    gives at most CROWD * k pairs a query and each vector once, and the crowd is ranked exactly where it lies.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(_doubles, "id long, dim int, v binary")
    rows = written(rows.distinct(), "doubles")
    known = fold_copies(rows, k + 1)
    sizes = written(known.groupBy("dim").agg(F.count("*").alias("n")), "dims")
    groups = max(1, -(-(sizes.agg(F.max("n")).first()[0] or 1) // CELL))
    sized = lambda df: df.join(sizes, "dim").select("id", "dim", "n", "v")
    asked = sized(rows.where(F.pmod("id", F.lit(EVERY)) == 0 if queries is None else queries))
    index = written(sized(known).mapInArrow(_index(tables, seed), "id long, dim int, tbl int, bucket long, home long, c binary, scale double, err double"), "index")
    singles = asked.mapInArrow(_singles, "id long, dim int, v binary")
    probed = asked.mapInArrow(_probes(tables, seed, probes), "id long, dim int, tbl int, buckets array<long>")
    found = written(_best_bounds(_bounds(index, probed, singles, k, groups), k), "bounds")

    enough = found.where("query_id is not null").groupBy("query_id").agg(F.countDistinct("vec_id").alias("m")).where(F.col("m") >= k).select(F.col("query_id").alias("id"))
    short = asked.join(enough, "id", "left_anti")
    one = index.where("tbl = 0")
    every = one.groupBy("dim").agg(F.collect_set("bucket").alias("buckets"))  # one table's buckets: some thousands at most
    rest = short.select("id", "dim").distinct().join(every, "dim").select("id", "dim", F.lit(0).alias("tbl"), "buckets")
    more = _best_bounds(_bounds(one, rest, short.mapInArrow(_singles, "id long, dim int, v binary"), k, groups), k)
    found = written(found.unionByName(more), "all-bounds")

    # vectors always come by id and dim under the same names, so one exchange of them serves all joins
    fetch = lambda df, name, v: df.withColumnRenamed(name, "id").join(rows, ["id", "dim"]).withColumnsRenamed({"id": name, "v": v})
    pairs = found.where("query_id is not null and vec_id is not null").select("query_id", "vec_id", "dim").distinct()
    pairs = fetch(fetch(pairs, "query_id", "q"), "vec_id", "v")
    exact = pairs.select("query_id", "vec_id", "q", "v").mapInArrow(_exact, "query_id long, vec_id long, score double")
    return merge_best(exact.unionByName(_crowds(found, fetch, k)), k)


def _best_bounds(found: DataFrame, k: int) -> DataFrame:
    """Of all cells' candidates and crowds those whose greatest possible cosine is not below the k-th best least one of their query; and the crowds' vectors once."""
    once = found.groupBy("query_id", "vec_id", "dim", "home").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    of = W.partitionBy("query_id", F.when(F.col("query_id").isNull(), F.col("vec_id")))
    ranked = once.withColumn("place", F.row_number().over(of.orderBy(F.desc("low"), "vec_id")))
    least = F.min(F.when(F.col("place") == k, F.col("low"))).over(of)
    return ranked.withColumn("least", least).where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_id", "vec_id", "low", "high", "dim", "home")
