"""The pipeline and the registered queries."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from _shared_docs import SCHEMA, edge_docs
from oracle import assert_same, connection
from tarnql.llm import personal_data, queries
from tarnql.llm._shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, after := spark.read.parquet(path)))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "redact", "mix", "tokenise"]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_poor_documents_go_and_good_ones_stay(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    poor = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in poor) <= 0.3 * len(poor)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]

    def runs(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: runs(r.text) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert kept == {find(i) for i in sets}


def test_personal_data_give_way(stages):
    before, after = stages[2]
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        out = texts[r.doc_id]
        if not personal_data.base_spans(r.text):
            assert out == r
        else:
            assert personal_data.base_spans(out.text) == [] and out.n_chars == len(out.text)


def test_documents_are_mixed_whole(stages):
    before, after = stages[3]
    rows = {r.doc_id: r for r in before.collect()}
    counts = Counter(r.doc_id for r in after.collect())
    assert all(r == rows[r.doc_id] for r in after.collect()) and max(counts.values()) <= 2
    from tarnql.llm.mixing import mix_sources

    assert counts == Counter({r.doc_id: r.epochs for r in mix_sources(before).collect() if r.epochs})


def test_tokens_are_those_of_the_library(stages):
    import sentencepiece

    from tarnql.llm.pieces import MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    before, after = stages[4]
    ids = {r.doc_id: r.ids for r in after.collect()}
    assert after.count() == before.count()
    assert all(ids[r.doc_id] == library.encode(r.text or "") for r in before.collect())


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1][1].columns
    digest = lambda df: Counter((r.doc_id, hashlib.md5(str(r.ids).encode()).hexdigest()) for r in df.collect())
    assert digest(got) == digest(stages[-1][1])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name, tmp_path):
    docs = edge_docs(spark, extra=False)
    spark.createDataFrame([(0, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs, str(tmp_path)).count() > 0
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connection(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"pipeline"}))
def test_other_queries_give_rows(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.count() >= 10 and len(set(got.columns)) == len(got.columns)
