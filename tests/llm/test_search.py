"""Exact and approximate search against brute force."""

import numpy as np
import pytest

from tarnql.llm.cross_polytope import bucket_plan, nearest_buckets, nearest_cosine, rotate, signs
from tarnql.llm.topk_search import search_block, segment_features, top_k_inner

NAN, INF = float("nan"), float("inf")
ODD = [(1000, None), (1001, [NAN] * 8), (1050, [1.0] * 7 + [INF]), (1003, [0.0] * 8), (None, [1.0] * 8), (1004, [None] + [1.0] * 7), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1102, []), (1150, [])]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).round(3)
    x[50:90] = x[50]  # copies, more of them than a query takes
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows + rows[60:64] + ODD, "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "1 as v", "2 as rank").repartition(4)


def parts(vectors):
    rows = {(r.vec_id, tuple(r.embedding)) for r in vectors.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)}
    return sorted(rows)


def test_top_k_is_exact(vectors):
    rows = parts(vectors)
    want = set()
    for q, a in rows:
        if q % 50 == 0:
            score = [(-sum(int(np.floor(256 * np.float64(x))) * int(np.floor(256 * np.float64(y))) for x, y in zip(a, b)), v) for v, b in rows if v != q and len(b) == len(a)]
            want |= {(q, k, v, -s) for k, (s, v) in enumerate(sorted(score)[:5], 1)}
    got = [tuple(r) for r in top_k_inner(vectors).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_large_numbers(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**30, 3.0]), (2, [1.0, 2.0**20]), (3, [-(2.0**30), 0.5])]
    got = top_k_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    ints = {k: [int(np.floor(256 * x)) for x in v] for k, v in rows}
    want = sorted(((sum(a * b for a, b in zip(ints[0], ints[k])), -k) for k in (1, 2, 3)), reverse=True)[:2]
    hold = lambda x: min(x, (1 << 63) - 1)
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(-k, hold(s)) for s, k in want]


@pytest.mark.parametrize("grouped", [False, True])
def test_cells_are_left_out_by_their_bounds(spark, monkeypatch, grouped):
    """Exact with many cells; on grouped vectors queries go to few of them."""
    from tarnql.llm import topk_search

    monkeypatch.setattr(topk_search, "CELL", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32))
    if grouped:
        levels = np.repeat(3 * rng.normal(size=(40, 4)), 8, axis=1)
        x = levels[rng.integers(0, 40, 2000)] + 0.1 * x
    x = x.astype(np.float32)
    report: dict = {}
    got = top_k_inner(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4), report=report)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()}
    ints = np.floor(256 * x.astype(float)).astype(np.int64)
    want = set()
    for q in range(0, 2000, 50):
        score = sorted((-int(s), v) for v, s in enumerate(ints @ ints[q]) if v != q)[:5]
        want |= {(q, k, v, -s) for k, (s, v) in enumerate(score, 1)}
    assert got == want and report["cells"] > 30
    if grouped:
        assert report["pairs"] < 0.5 * report["cells"] * report["queries"]


def test_features_bound_inner_products():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 30)), rng.normal(size=(30, 30))
    exact = x @ y.T
    coarse, fine = (segment_features(x, s) @ segment_features(y, s).T for s in (4, 16))
    assert (coarse >= exact - 1e-9).all() and (fine >= exact - 1e-9).all()


def test_few_vectors():
    found = list(search_block(np.array([5]), np.ones((1, 3), np.int64), np.array([5, 6]), np.ones((2, 3), np.int64), 5))
    assert [(i, v.tolist(), s.tolist()) for i, v, s in found] == [(5, [6], [3])]


@pytest.mark.parametrize("search", [top_k_inner, nearest_cosine])
def test_empty_table(spark, search):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_rotations_keep_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10, 24))
    for rounds in signs(24, 2, 1, 7)[:, 0]:
        assert np.allclose(np.linalg.norm(rotate(x, rounds), axis=1), np.linalg.norm(x, axis=1))
    rotations = signs(24, 1, 2, 7)[0]
    buckets = nearest_buckets(x, rotations, 4, 5)
    assert buckets.shape == (10, 5) and buckets.max() < 64 * 8 and (buckets[:, :1] == nearest_buckets(x, rotations, 4, 1)).all()


def test_nearest_cosine(vectors):
    rows = [(k, np.array(v)) for k, v in parts(vectors) if len(v) and any(v)]
    got = nearest_cosine(vectors).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, a in rows:
        if q % 50:
            continue
        score = {v: float(a @ b / np.sqrt((a @ a) * (b @ b))) for v, b in rows if v != q and len(b) == len(a)}
        found = sorted(by[q])
        assert [k for k, *_ in found] == list(range(1, min(5, len(score)) + 1))
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in found) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        hits, total = hits + len({v for v, _ in best} & {v for _, v, _ in found}), total + len(best)
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(by[50])] == [51, 52, 53, 54, 55]  # of equal vectors the smallest ids
    assert nearest_cosine(vectors, tables=3, probes=60).count() > 0


def recall(spark, x):
    """Of queries' five nearest by brute force, the share that the index finds; and rows a query."""
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found: dict = {}
    for r in nearest_cosine(rows).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9
    hits = total = 0
    for q in range(0, len(x), 50):
        score = unit @ unit[q]
        score[q] = -2
        best = set(np.argsort(-score)[:5].tolist())
        assert len(found[q]) == min(5, len(x) - 1)
        hits, total = hits + len(best & found[q]), total + len(best)
    return hits / total


@pytest.mark.parametrize("n", [2000, 8000])
def test_recall_on_64_components(spark, n):
    assert recall(spark, np.random.default_rng(n).normal(size=(n, 64))) >= 0.9


def test_recall_in_groups_and_hot_buckets(spark, monkeypatch):
    """A third of the vectors lie close together: their bucket is dealt to several cells."""
    from tarnql.llm import cross_polytope

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + 0.05 * rng.normal(size=(1000, 64))
    monkeypatch.setattr(cross_polytope, "CELL", 64)
    assert recall(spark, x) >= 0.9


def test_rows_do_not_grow_with_near_copies_of_queries(spark, monkeypatch):
    """A quarter or all of the vectors lie so close together that bytes do not tell them apart; some are multiples of others."""
    from tarnql.llm import cross_polytope

    made, bounds = [], cross_polytope._bounds
    monkeypatch.setattr(cross_polytope, "_bounds", lambda *a: made.append(bounds(*a)) or made[-1])
    monkeypatch.setattr(cross_polytope, "CELL", 512)
    rng = np.random.default_rng(4)
    rows = []
    for share in (4, 1):
        x = rng.normal(size=(4000, 64))
        x[::share] = x[0] + 0.1 * rng.normal(size=(4000 // share, 64))
        x[4:2000:40] = x[0] * (1 + np.arange(50)[:, None])
        x = x.astype(np.float32).astype(float)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        found: dict = {}
        for r in nearest_cosine(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
            found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        rows.append(made[-2].count())  # the last one is of queries that found too few
        hits = 0
        for q in range(0, 4000, 100):
            score = unit @ unit[q]
            score[q] = -2
            assert all(abs(s - score[v]) < 1e-12 for v, s in found[q].values()) and sorted(found[q]) == [1, 2, 3, 4, 5]
            hits += sum(s >= np.sort(score)[-5] - 1e-12 for _, s in found[q].values())
        assert hits >= 0.98 * 200
    assert rows[0] < 100_000 and rows[1] < 200_000  # 425,624 and 3,199,200 when each candidate was a pair


def test_a_crowd_is_ranked_exactly():
    """All of a bucket's vectors that bytes do not tell apart are named, and ranked by their cosine, a repeated id once."""
    import pyarrow as pa

    from tarnql.llm import cross_polytope

    rng = np.random.default_rng(6)
    x = np.ones(16) + 1e-4 * rng.normal(size=(300, 16))
    ids = np.concatenate((np.arange(290), np.full(10, 7)))
    unit = cross_polytope.units(x)
    scale = np.abs(unit).max(1) / 127
    c = np.rint(unit / scale[:, None]).astype(np.int8)
    err = np.linalg.norm(unit - c * scale[:, None], axis=1)
    home = np.arange(300) % 3
    cell = pa.table({"id": ids, "dim": pa.array([16] * 300, pa.int32()), "bucket": pa.array([5] * 300, pa.int64()), "home": home, "c": [r.tobytes() for r in c], "scale": scale, "err": err})
    queries = pa.table({"id": ids[:20], "dim": pa.array([16] * 20, pa.int32()), "v": [r.tobytes() for r in unit[:20].astype(np.float32)], "buckets": pa.array([[5, 6]] * 20, pa.list_(pa.int64()))})
    got = cross_polytope._bounded(5)(queries, cell).to_pylist()
    pairs, asked, crowd = ([r for r in got if (r["query_id"] is None, r["vec_id"] is None) == kind] for kind in ((False, False), (False, True), (True, False)))
    assert len(pairs) == 5 * 20 and {(r["query_id"], r["home"]) for r in asked} == {(q, h) for q in range(20) for h in range(3)} and len(asked) == 60
    assert {(r["query_id"], r["vec_id"]) for r in pairs} | {(q, r["vec_id"]) for q in range(20) for r in crowd} >= {(q, v) for q in range(20) for v in range(290) if v != q}
    assert len(crowd) <= 300 and {(r["vec_id"], r["home"]) for r in crowd} <= set(zip(ids.tolist(), home.tolist()))

    asked, crowd = pa.table({"query_id": ids[:20], "q": [r.tobytes() for r in x[:20]]}), pa.table({"vec_id": ids, "v": [r.tobytes() for r in x]})
    ranked = cross_polytope._ranked(5)(asked, crowd).to_pylist()
    for q in range(20):
        best: dict = {}
        for v, s in zip(ids.tolist(), cross_polytope.cosine_rows(x[q], x).tolist()):
            if v != q:
                best[v] = max(best.get(v, -2), s)
        want = sorted(((-s, v) for v, s in best.items()))[:5]
        assert [(-r["score"], r["vec_id"]) for r in ranked if r["query_id"] == q] == want


@pytest.mark.parametrize("n", [2, 4, 6])
def test_few_vectors_are_all_found(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    got = nearest_cosine(spark.createDataFrame([(50 * k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert len(got) == n * min(5, n - 1)


def test_comparisons_grow_slower_than_vectors():
    """Expected share of a table that a query is compared to, for 64 components."""
    def share(n):
        axes, probes = bucket_plan(n, 64)
        return probes / (128 * max(1, 2 * axes))

    shares = [share(n) for n in (2_000, 50_000, 10**6, 10**9)]
    assert all(a > 1.3 * b for a, b in zip(shares, shares[1:])) and shares[-1] < 0.005
