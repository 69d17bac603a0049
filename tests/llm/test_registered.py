"""The registered queries that SQL cannot express, on the whole tables of the smallest scale, against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tarnql.llm import personal_data, queries
from tarnql.llm._shared import table
from test_documents import brute_fingerprint, check_shards, components
from test_models import brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_nearest_neighbours(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    cosine = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    got = defaultdict(list)
    for r in sorted(run(spark, "op3_cross_polytope"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    place, found = {v: k for k, v in enumerate(ids.tolist())}, 0
    assert set(got) == {v for v in place if v % 50 == 0}
    for q, mine in got.items():
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in mine} and len({r.vec_id for r in mine}) == 5
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert np.allclose([r.score for r in mine], [cosine[place[q], place[r.vec_id]] for r in mine], rtol=0, atol=1e-12)
        best = sorted((-cosine[place[q], k], v) for v, k in place.items() if v != q)[:5]
        found += len({v for _, v in best} & {r.vec_id for r in mine})
    assert found >= 0.9 * 5 * len(got)


def test_pieces(spark, texts):
    import sentencepiece

    from tarnql.llm.pieces import MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in run(spark, "op4_sentencepiece")}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.ids == library.encode(texts[i] or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_fingerprints_and_components(spark, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op6_simhash_neardup")}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_shards(spark, texts):
    got = run(spark, "op7_histogram_sharding")
    sizes = check_shards(list(texts.items()), got, 16)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    total, slack = sum(sizes), max(0.01 * sum(sizes) / 16, max(r["size"] for r in got))
    assert all(abs(sum(sizes[:k]) - total * k / 16) <= slack for k in range(1, 16))


def test_personal_data(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op10_skip_chain_crf")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base, r = brute_spans(t or ""), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, kind in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(personal_data.shown(base).encode()).hexdigest()
        assert {x for x in personal_data.shown(base).split(",") if x} <= set(r.spans.split(","))


def test_quality(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op2_cotraining")}
    assert set(got) == set(texts)
    assert all(0 <= p <= 1 for r in got.values() for p in (r.p_content, r.p_metadata, r.p_quality)) and all(r.keep == (r.p_quality >= 0.5) for r in got.values())
    judged = defaultdict(list)
    for r in table(spark, SF, "labels").collect():
        judged[r.quality].append(got[r.doc_id].p_quality)
    right = np.mean([a > b for a in judged[1] for b in judged[0]])
    assert right >= 0.95
