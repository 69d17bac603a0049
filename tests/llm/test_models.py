"""Classifier, SentencePiece and personal data: held-out accuracy, round trips, brute force."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

from _shared_docs import EDGE, LONG, edge_docs, empty_docs
from tarnql.llm import cotraining, personal_data, pieces
from tarnql.llm._words import Words

# ---- co-training -----------------------------------------------------------------------------------------------------

GOOD, POOR = "the river runs down to the sea and children play by its side".split(), "buy cheap pills win casino click offer now free prize".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        good = i % 3 != 0
        text = " ".join(rng.choice(GOOD if good else POOR, 40)) if good else " ".join(w.upper() + "!!" for w in rng.choice(POOR, 40))
        rows.append((i, text, "en", "books" if rng.random() < (0.8 if good else 0.2) else "spam", len(text), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, truth int").selectExpr("*", "1 as y", "2 as h", "3 as p_quality")
    return df.repartition(4).cache()


def test_held_out_accuracy(spark, corpus):
    labels = corpus.where("doc_id < 200").selectExpr("doc_id", "truth as quality", "0 as toxic")
    model = cotraining.train(corpus, labels)
    got = cotraining.classify(corpus, model)
    assert got.columns == [c for c in corpus.columns if c != "p_quality"] + ["p_content", "p_metadata", "p_quality", "keep"]
    held = got.where("doc_id >= 200").collect()
    assert len(held) == 700
    assert np.mean([r.keep == bool(r.truth) for r in held]) > 0.98
    assert np.mean([(r.p_content > 0.5) == bool(r.truth) for r in held]) > 0.95
    again = cotraining.classify(corpus, cotraining.train(corpus, labels)).where("doc_id >= 200").collect()
    assert {r.doc_id: r.p_quality for r in again} == pytest.approx({r.doc_id: r.p_quality for r in held})


def test_views_learn_from_each_other():
    """Metadata that the labelled rows lack is learnt from what the content view is sure of."""
    rng = np.random.default_rng(2)
    n = 1200
    truth = rng.integers(0, 2, n)
    content = cotraining.Sparse(np.repeat(np.arange(n), 3), (truth[:, None] * 50 + rng.integers(0, 50, (n, 3))).reshape(-1), np.full(3 * n, 10.0), n)
    y = np.where(np.arange(n) < 300, truth, -1)
    source = np.where(np.arange(n) < 300, 0, 1 + truth)  # only unlabelled pages have these sources
    model = cotraining.co_train(content, np.stack((source, np.zeros(n, int)), 1), rng.normal(size=(n, cotraining.STATS)), y)
    assert model.meta[2] - model.meta[1] > 0.5


def test_shapes_and_features():
    w = Words(pa.array([b"Hello WORLD!! x9 abc", b"Adieu MONDE!! y7 zzz"], pa.binary()))
    s = cotraining._shapes(w)
    assert s[:4].tolist() == s[4:].tolist() and len(set(s[:4].tolist())) == 4
    row, number = cotraining.content_features(pa.array(["a a b", None]))
    assert row.tolist().count(0) == 3 + 3 + 1 and 1 not in row and number.max() == cotraining.DIM - 1


def test_scores_are_those_of_single_pages(spark, corpus):
    """Scores page by page, in plain loops over the model's weights, against the batched ones."""
    model = cotraining.train(corpus, corpus.where("doc_id < 200").selectExpr("doc_id", "truth as quality"))
    got = {r.doc_id: r for r in cotraining.classify(corpus, model).where("doc_id % 60 = 0").collect()}
    for r in corpus.where("doc_id % 60 = 0").collect():
        row, number = cotraining.content_features(pa.array([r.text]))
        z = sum(model.content[f] for f in number.tolist()) * cotraining.SCALE / len(r.text.split()) + model.content[-1]
        buckets, stats = cotraining.metadata_numbers(pa.array([r.text]), pa.array([r.source]), pa.array([r.lang]), pa.array([r.n_chars]))
        places = [buckets[0, 0], cotraining.SOURCES + buckets[0, 1]] + [cotraining.SOURCES + cotraining.LANGS + cotraining.BINS * k + sum(stats[0, k] >= e for e in model.edges[k]) for k in range(cotraining.STATS)]
        m = sum(model.meta[p] for p in places) + model.meta[-1]
        a, b = (s * x + t for x, (s, t) in zip((z, m), model.scales))
        both = model.weights[0] * a + model.weights[1] * b + model.weights[2]
        assert got[r.doc_id].p_quality == pytest.approx(1 / (1 + np.exp(-both)), abs=1e-9) and got[r.doc_id].p_content == pytest.approx(1 / (1 + np.exp(-a)), abs=1e-9)


def test_metadata_without_layout(spark, corpus):
    labels = corpus.where("doc_id < 300").selectExpr("doc_id", "truth as quality")
    model = cotraining.train(corpus, labels, layout=False)
    assert not model.meta[cotraining.SOURCES + cotraining.LANGS + cotraining.BINS : -1].any()
    held = cotraining.classify(corpus, model).where("doc_id >= 300").collect()
    assert np.mean([r.keep == bool(r.truth) for r in held]) > 0.95
    assert len({round(r.p_metadata, 9) for r in held}) <= 2 * cotraining.BINS


def test_an_id_of_many_rows_is_learnt_from_once(spark, corpus):
    labels = corpus.where("doc_id < 200").selectExpr("doc_id", "truth as quality")
    again = corpus.unionByName(corpus.where("doc_id = 3").crossJoin(spark.range(50)).drop("id"))
    a, b = cotraining.train(corpus, labels), cotraining.train(again, labels)
    assert np.allclose(a.content, b.content) and np.allclose(a.meta, b.meta)


def test_classifier_edges(spark, corpus):
    labels = corpus.selectExpr("doc_id", "truth as quality")
    model = cotraining.train(corpus, labels)
    got = cotraining.classify(edge_docs(spark), model)
    assert got.count() == len(EDGE) and got.where("p_quality is null or keep is null").count() == 0
    assert cotraining.classify(empty_docs(spark), model).collect() == []
    assert cotraining.train(empty_docs(spark), labels) is None
    assert cotraining.train(corpus, labels.where("quality = 1")) is None
    assert cotraining.train(corpus, labels.selectExpr("doc_id", "cast(null as int) quality")) is None
    unjudged = cotraining.classify(edge_docs(spark), None)
    assert unjudged.where("keep and p_quality is null").count() == len(EDGE)
    assert cotraining.classify(spark.createDataFrame([("a b",)], "text string"), model).count() == 1


# ---- SentencePiece ---------------------------------------------------------------------------------------------------

PARTS = ["a", "b", "the", "in", " ", "  ", "   ", "é", "日", "本", "\n", "\t", "🙂", "er", "ing", "aaaa", "zz", "\0", "ß", "x" * 30, "tion", "\r", "http://", "=====", "...", "▁"]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def some_texts(n):
    r = random.Random(4)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["", " ", "lone", LONG[:5000], "ab" * 3000]


def test_ids_are_those_of_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = some_texts(600)
    got = [np.frombuffer(x, np.int32).tolist() for x in model.encode_packed(texts)]
    assert got == library.encode(texts)
    assert [model.decode(x) for x in got] == library.decode(got)
    assert [model.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_batched_search_is_that_of_single_words(model):
    words = sorted({w for t in some_texts(300) for w in t.replace(" ", "▁").split("▁") if 0 < len(w) <= 20})
    for n in {len(w) for w in words}:
        same = [w for w in words if len(w) == n]
        assert model._packed_ids(same) == [model._packed(model._tokens_of_one(w)) for w in same]


def test_long_words_of_any_length(model):
    """Unspaced texts, which are single words: positions at once, ids as of the library, and quick enough."""
    import time

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(9)
    signs = "".join(chr(x) for x in range(33, 127)) + "日本語テキスト中文字é"
    texts = ["".join(r.choice(signs) for _ in range(n)) for n in (49, 50, 500, 3000)] + ["".join(r.choice(PARTS).strip() for _ in range(2000)), "a" * 4000, "0123456789" * 300]
    assert [np.frombuffer(x, np.int32).tolist() for x in model.encode_packed(texts)] == library.encode(texts)
    assert all(len(w) <= pieces.BATCHED for w in model.known)
    began = time.time()
    model.encode_packed(["".join(r.choice(signs) for _ in range(100_000))])
    assert time.time() - began < 5


def test_remembered_words_are_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 20_000)
    for k in range(20):
        model.encode_packed([" ".join(f"w{k}x{j}" for j in range(60))])
        assert model.held <= 20_000 + 70 * (pieces.EACH + 60)


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(*fields):
    return b"".join(varint(k << 3 | 2) + varint(len(x)) + x if isinstance(x, bytes) else varint(k << 3 | 5) + struct.pack("<f", x) if isinstance(x, float) else varint(k << 3) + varint(x) for k, x in fields)


def test_unigram_models_find_the_best_sum():
    vocabulary = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "aba": -7.2, "▁a": -4.1, "bb": -3.6, "c": -9.0}
    parts = [message((1, b"<unk>"), (2, 0.0), (3, 2))] + [message((1, p.encode()), (2, s)) for p, s in vocabulary.items()]
    model = pieces.Pieces(message(*((1, p) for p in parts), (2, message((3, 1))), (3, message((3, 1), (4, 0)))))

    def best(text):
        if not text:
            return 0.0
        return max([vocabulary[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in vocabulary] or [min(vocabulary.values()) - 10 + best(text[1:])])

    r = random.Random(3)
    for text in ["".join(r.choice("aabbbc z") for _ in range(r.randint(1, 9))) for _ in range(100)]:
        ids = model.encode(text)
        score = sum(model.scores[i] if i else 0 for i in ids)
        known = (" " + text).replace(" ", "▁")
        assert score + (min(vocabulary.values()) - 10) * known.count("z") == pytest.approx(best(known), abs=1e-4)


def test_models_that_are_not_supported():
    with pytest.raises(ValueError):
        pieces.Pieces(message((1, message((1, b"<unk>"), (3, 2))), (3, message((4, 1)))))


def test_encoding_of_tables(spark):
    df = edge_docs(spark)
    got = pieces.encode(df, check="same")
    assert got.columns == [*df.columns, "ids", "same"]
    rows = got.collect()
    assert len(rows) == len(EDGE) and all(r.same for r in rows) and all(r.ids == [] for r in rows if not r.text)
    back = pieces.decode(got.withColumnRenamed("text", "before"))
    assert all(r.text == (r.before or "") for r in back.collect())
    assert pieces.encode(empty_docs(spark)).collect() == []


# ---- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            check = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and check == 0 or kind == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_against_brute_force():
    r = random.Random(2)
    signs = [*"a1@.+-() 9", "a@b.c", "1.2.3.4", "4111111111111111", "4111-1111 11111111", "+1 (555) 123-4567", "0256.", "é", "_", "%", "00", "@@", ".."]
    for _ in range(20000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert personal_data.base_spans(text) == brute_spans(text), text


DOC = "Call +1 (743) 555-3824 or mail joe.bloggs@mail.example.com, card 4845168114407329. Later 555-3824 again, joe.bloggs@mail too; 4845168114407320 in 2024."


@pytest.fixture(scope="module")
def field(spark):
    r = random.Random(7)

    def doc(i):
        tel, mail = f"{r.randint(100, 999)}-{r.randint(1000, 9999)}", f"user{r.randint(1000, 9999)}@mail.example.com"
        return i, f"in {r.randint(1900, 2030)} call +1 ({r.randint(200, 999)}) {tel} or {mail} then {mail} or +1 (555) {tel}, item {r.randint(10000, 99999)} of {r.randint(100, 400)} costs {r.randint(1, 99)}.50"

    return personal_data.train_field(spark.createDataFrame([doc(i) for i in range(300)], "doc_id long, text string"))


def test_field_carries_labels_to_similar_words(field):
    base = personal_data.base_spans(DOC)
    got = {DOC[a:b]: personal_data.KINDS[k] for a, b, k in field.added([DOC], [base])[0]}
    assert got.get("555-3824") == "phone" and got.get("joe.bloggs@mail") == "email" and "2024" not in got
    assert field.added(["in 2024 we sold 12345 items", None, "", "no node"], [[]] * 4) == [[]] * 4


def test_messages_on_a_tree_are_exact():
    """Without loops, marginals are those of all labellings."""
    rng = np.random.default_rng(3)
    f = personal_data.Field(rng.normal(size=(personal_data.FEATURES + 1, personal_data.LABELS)), rng.normal(size=(3, personal_data.LABELS, personal_data.LABELS)))
    features, links = [[0], [1, 2], [3], [4]], np.array([(0, 1, 0), (1, 2, 1), (1, 3, 2)])
    got = f.marginals(features, np.zeros(4, int), links, rounds=100, damp=0.0)
    theta = np.array([f.node[-1] + f.node[x].sum(0) for x in features])
    want = np.zeros((4, personal_data.LABELS))
    for labels in np.ndindex(*[personal_data.LABELS] * 4):
        p = np.exp(sum(theta[k, y] for k, y in enumerate(labels)) + sum(f.link[kind, labels[a], labels[b]] for a, b, kind in links))
        for k, y in enumerate(labels):
            want[k, y] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table_rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text rlike '[0-9@]'").collect()]


def test_disguised_spans_are_found(spark, table_rows):
    """Trained on even ids; in the texts of odd ids spans are written so that the patterns miss them: what the field adds, by span."""
    even = spark.createDataFrame([r for r in table_rows if r[0] % 2 == 0], "doc_id long, text string")
    field = personal_data.train_field(even)
    right = wrong = lost = plain = 0
    meets = lambda x, spans: any(s[0] < x[1] and s[1] > x[0] for s in spans)
    for i, text in table_rows:
        if i % 2:
            base = personal_data.base_spans(text)
            plain += len(field.added([text], [base])[0])
            hidden, truth = personal_data.perturbed(text, base, i)
            found = personal_data.base_spans(hidden)
            got = field.added([hidden], [found])[0]
            right += sum(meets(x, got) for x in truth if not meets(x, found))
            lost += sum(not meets(x, got) for x in truth if not meets(x, found))
            wrong += sum(not meets(x, truth) for x in got)
    assert right >= 0.6 * (right + lost) > 60 and wrong <= 0.05 * right and plain <= 3


def test_messages_on_graphs_of_the_table(table_rows, field):
    """Labels of small graphs of real texts, loops and all, against all labellings."""
    checked = agree = 0
    for _, text in table_rows:
        base = personal_data.base_spans(text)
        g = personal_data.graph(text, base)
        if not 2 <= len(g.spans) <= 6 or not g.links:
            continue
        n, links = len(g.spans), np.array(g.links)
        got = field.marginals(g.features, np.array(g.fixed), links)
        theta = np.array([field.node[-1] + field.node[x].sum(0) for x in g.features])
        for k, y in enumerate(g.fixed):
            if y:
                theta[k] = -personal_data.FIXED
                theta[k, y] = personal_data.FIXED
        labels = np.stack(np.meshgrid(*[np.arange(personal_data.LABELS)] * n, indexing="ij"), -1).reshape(-1, n)
        score = sum(theta[k, labels[:, k]] for k in range(n)) + sum(field.link[kind, labels[:, a], labels[:, b]] for a, b, kind in g.links)
        p = np.exp(score - score.max())
        want = np.array([[p[labels[:, k] == y].sum() for y in range(personal_data.LABELS)] for k in range(n)]) / p.sum()
        sure = want.max(1) >= personal_data.CERTAIN
        checked, agree = checked + sure.sum(), agree + (got.argmax(1) == want.argmax(1))[sure].sum()
        if checked > 300:
            break
    assert checked > 100 and agree >= 0.99 * checked


def test_repeated_ids_and_long_texts_train_by_counts(spark):
    rows = [(i, DOC + f" {i}") for i in range(20)] + [(1, DOC)] * 30 + [(99, " ".join(f"{k} a{k}@b" for k in range(3000))), (None, DOC), (98, None), (97, "")]
    field = personal_data.train_field(spark.createDataFrame(rows, "doc_id long, text string"))
    assert np.isfinite(field.node).all() and np.isfinite(field.link).all()


def test_personal_data_of_tables(spark, field):
    df = edge_docs(spark).unionByName(spark.createDataFrame([(50, DOC)], "doc_id long, text string"), allowMissingColumns=True)
    got = personal_data.find_personal_data(df, field)
    assert got.columns == [*df.columns, "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
    for r in got.collect():
        base = brute_spans(r.text)
        assert r.base_spans == personal_data.shown(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in range(4)]
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(",")) or not base
    red = {r.doc_id: r.text for r in personal_data.find_personal_data(df, field, redact=True).collect()}
    assert "[EMAIL]" in red[9] and "joe" not in red[9] and red[3] is None and red[7] == LONG
    assert "[PHONE]" in red[50] and "555-3824" not in red[50]
    assert personal_data.find_personal_data(empty_docs(spark)).collect() == []
    assert personal_data.find_personal_data(edge_docs(spark)).count() == len(EDGE)


def test_overlapping_spans_are_joined():
    assert personal_data.redacted("ab+12 34cd", [(2, 8, 3), (3, 8, 2)]) == "ab[PHONE]cd"
    assert personal_data.redacted(None, []) is None
