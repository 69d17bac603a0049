"""Quality classification by co-training of two views of a page.

The content view looks at the words of the text: hashed words, their shapes (runs of letters, digits and other characters
as one sign each), and repeats. The metadata view looks at the page's source, language and length, and, unless it is told not to, at statistics
of its layout (lines, sizes, shares of kinds of characters), but at no word. Both are logistic regressions. In every round each view labels the pages of an unlabelled pool that it
is most sure of, in the proportion of the classes, and hands them to the other view to learn from. In the end each
view is calibrated on labelled pages that neither has seen, and all documents get the combined log-odds of both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ._words import SPACE, Words, give_back, lean, slices, small_steps

WORDS, SHAPES = 1 << 13, 1 << 9
DIM = WORDS + SHAPES + 1  # the last feature: a word that repeats the one before
SCALE = 30.0
SOURCES, LANGS, BINS = 64, 16, 12
STATS = 10
META = SOURCES + LANGS + STATS * BINS
STEP = 1 << 20  # bytes of text that are worked on at a time
LABELLED, POOL = 6000, 6000  # bounds of the samples that the views are trained on; all documents are scored
FOLDS = (0.7, 1.0)  # of the labelled sample, what is learnt from; the rest calibrates

LOWER_, UPPER_, DIGIT_ = 1, 2, 3
CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("a") : ord("z") + 1] = LOWER_
CLASS[ord("A") : ord("Z") + 1] = UPPER_
CLASS[ord("0") : ord("9") + 1] = DIGIT_
CLASS[128:] = LOWER_


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.binary()), b"")


def _shapes(words: Words) -> np.ndarray:
    """For each word a number below SHAPES for its sequence of character classes, runs taken once."""
    kind = CLASS[words.data].astype(np.uint64)
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[words.start] = True
    place = np.cumsum(fresh)  # number of the run within the batch
    inside = np.zeros(len(kind) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    at = np.flatnonzero(fresh & (np.cumsum(inside[:-1]) > 0))
    word = np.searchsorted(words.start, at, "right") - 1
    nth = place[at] - place[words.start[word]]
    h = np.bincount(word, ((kind[at].astype(np.int64) * 2654435761 >> np.minimum(nth, 3) * 4) & 0xFFFF).astype(float), len(words.start))
    return (h.astype(np.int64) * 40503 >> 5) % SHAPES


def content_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a feature its row and number; a row's features weigh SCALE / its words."""
    w = Words(_texts(column))
    h = w.hashes(0)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    number = np.concatenate(((h >> np.uint64(64 - 13)).astype(np.int64), WORDS + _shapes(w), np.full(again.sum(), DIM - 1)))
    return np.concatenate((w.doc, w.doc, w.doc[again])), number


def metadata_numbers(texts: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of source and language, and the page's layout statistics, a row of STATS numbers each."""
    from xxhash import xxh32_intdigest

    bucket = lambda col, n, seed: np.array([xxh32_intdigest(x if x is not None else b"\xff", seed) % n for x in col.cast(pa.binary()).to_pylist()], np.int64)
    texts = _texts(texts)
    w = Words(texts)
    rows = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(rows), sizes)
    kind = CLASS[w.data]
    count = lambda mask: np.bincount(doc[mask], minlength=rows)
    some = np.maximum(sizes, 1)
    words = np.diff(w.first)
    lines = count(w.data == 10) + 1
    h = w.hashes(0)
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=rows)
    chars = np.where(n_chars.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(n_chars, 0).to_numpy(zero_copy_only=False), sizes).astype(float)
    punct = (kind > 3) & ~SPACE[w.data]
    ends = np.bincount(w.doc[punct[w.end - 1]] if len(w.end) else w.doc, minlength=rows)
    stats = [
        np.log1p(np.maximum(chars, 0)), np.log1p(words), lines / some, np.log1p(some / lines), sizes / np.maximum(words, 1),
        count(kind == UPPER_) / some, count(kind == DIGIT_) / some, count(punct) / some, distinct / np.maximum(np.sqrt(words), 1), ends / np.maximum(words, 1),
    ]
    return np.stack((bucket(source, SOURCES, 1), bucket(lang, LANGS, 2)), 1), np.stack(stats, 1)


def logistic(x) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_odds(p) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Sparse:
    """Rows of weighted features."""

    row: np.ndarray
    number: np.ndarray
    value: np.ndarray
    rows: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.number] * self.value, self.rows)

    def take(self, keep: np.ndarray) -> Sparse:
        place = np.full(self.rows, -1)
        place[keep] = np.arange(len(keep))
        mine = place[self.row] >= 0
        return Sparse(place[self.row[mine]], self.number[mine], self.value[mine], len(keep))


def fit_logistic(x: Sparse, y: np.ndarray, dim: int, steps: int = 80, rate: float = 0.1, decay: float = 1e-4, start=None) -> np.ndarray:
    """Weights, the last of them the intercept, of a regularised logistic regression; full-batch Adam, so without chance."""
    w = np.zeros(dim + 1) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        error = (logistic(x.dot(w) + w[-1]) - y) / len(y)
        g = np.bincount(x.number, x.value * error[x.row], dim + 1)
        g += decay * w
        g[-1] = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class CoTrained:
    """Both views' weights, the bins of the layout statistics, each view's calibration (slope, shift), and the weights and shift of the combination."""

    content: np.ndarray
    meta: np.ndarray
    edges: np.ndarray
    scales: tuple[tuple[float, float], tuple[float, float]]
    weights: tuple[float, float, float]
    layout: bool = True

    def views(self, texts: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of good quality by content and by metadata."""
        row, number = content_features(texts)
        words = np.maximum(np.bincount(row[number < WORDS], minlength=len(texts)), 1)
        a = np.bincount(row, self.content[number], len(texts)) * SCALE / words + self.content[-1]
        buckets, stats = metadata_numbers(texts, source, lang, n_chars)
        b = meta_features(buckets, stats, self.edges, self.layout).dot(self.meta) + self.meta[-1]
        return tuple(s * z + t for z, (s, t) in zip((a, b), self.scales))

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.weights[0] * a + self.weights[1] * b + self.weights[2]


def meta_features(buckets: np.ndarray, stats: np.ndarray, edges: np.ndarray, layout: bool = True) -> Sparse:
    """The numbers of source, language and the bins of length and of the other statistics, if layout."""
    n = len(buckets)
    bins = np.stack([np.searchsorted(edges[k], stats[:, k], "right") for k in range(STATS)], 1) + SOURCES + LANGS + BINS * np.arange(STATS)
    number = np.concatenate((buckets[:, :1], SOURCES + buckets[:, 1:], bins if layout else bins[:, :1]), 1)
    return Sparse(np.repeat(np.arange(n), number.shape[1]), number.reshape(-1), np.ones(number.size), n)


def co_train(content: Sparse, buckets: np.ndarray, stats: np.ndarray, y: np.ndarray, rounds: int = 4, share: float = 0.1, sure: float = 0.9, layout: bool = True) -> CoTrained | None:
    """y: 1 good, 0 poor, -1 unlabelled, in an order that is random in itself. In each round a view hands over at most share of the pool.

    None if the part to learn from or the part to calibrate on lacks a class.
    """
    known = np.flatnonzero(y >= 0)
    learn, held = np.split(known, [int(FOLDS[0] * len(known))])
    if min(len(set(y[learn])), len(set(y[held]))) < 2:
        return None
    edges = np.quantile(stats[y < 0] if (y < 0).sum() > BINS else stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    meta = meta_features(buckets, stats, edges, layout)
    views, dims = (content, meta), (DIM, META)
    pool, prior = y < 0, y[learn].mean()
    sets = [(learn, y[learn].astype(float)) for _ in views]
    weights: list = [None, None]
    for r in range(rounds + 1):
        weights = [fit_logistic(x.take(rows), target, dim, start=w, steps=150 if w is None else 50) for x, (rows, target), dim, w in zip(views, sets, dims, weights)]
        if r == rounds or not pool.any():
            break
        handed = []
        for x, w in zip(views, weights):
            p = logistic(x.dot(w) + w[-1])
            p = np.where(pool, p, 0.5)
            n = max(1, int(share * pool.sum()))
            best, worst = np.argsort(-p, kind="stable")[: max(1, int(n * prior))], np.argsort(p, kind="stable")[: max(1, int(n * (1 - prior)))]
            best, worst = best[p[best] >= sure], worst[p[worst] <= 1 - sure]
            handed.append((np.concatenate((best, worst)), np.concatenate((np.ones(len(best)), np.zeros(len(worst))))))
        for k in (0, 1):
            rows, target = handed[1 - k]
            new = ~np.isin(rows, sets[k][0])
            sets[k] = np.concatenate((sets[k][0], rows[new])), np.concatenate((sets[k][1], target[new]))
        pool = pool & ~np.isin(np.arange(len(y)), np.concatenate([h[0] for h in handed]))
    scales, calibrated = [], []
    for x, w in zip(views, weights):
        z = (x.dot(w) + w[-1])[held]
        scales.append(tuple(_fit_dense(z[:, None], y[held], [1.0, 0.0]).tolist()))
        calibrated.append(scales[-1][0] * z + scales[-1][1])
    both = _fit_dense(np.stack(calibrated, 1), y[held], [0.5, 0.5, 0.0])
    return CoTrained(weights[0], weights[1], edges, tuple(scales), tuple(both.tolist()), layout)


def _fit_dense(x: np.ndarray, y: np.ndarray, start: list[float]) -> np.ndarray:
    n, k = x.shape
    return fit_logistic(Sparse(np.repeat(np.arange(n), k), np.tile(np.arange(k), n), x.reshape(-1), n), y, k, steps=400, rate=0.05, decay=1e-3, start=np.array(start))


def _sample_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sparse]:
    """Labels and features of a bounded sample, in the order of its hashes; texts stay on the executors."""

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, 2, STEP)):
            row, number = content_features(b.column(2))
            words = np.maximum(np.bincount(row[number < WORDS], minlength=len(b)), 1)
            key, count = np.unique(row * DIM + number, return_counts=True)
            row, number = key // DIM, key % DIM
            cut = np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x))
            buckets, stats = metadata_numbers(b.column(2), b.column(3), b.column(4), b.column(5))
            nested = lambda x, t: pa.array([r.tolist() for r in x], pa.list_(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(number.astype(np.int32)), lists((count * SCALE / words[row]).astype(np.float32)), nested(buckets, pa.int32()), nested(stats, pa.float64())], ["h", "y", "number", "value", "buckets", "stats"])

    schema = "h long, y int, number array<int>, value array<float>, buckets array<int>, stats array<double>"
    got = rows.mapInArrow(lean(run), schema).toArrow().combine_chunks().sort_by("h")
    n = got.num_rows
    parts = {c: got[c].combine_chunks() for c in got.column_names}
    sizes = pc.list_value_length(got["number"]).to_numpy().astype(np.int64)
    flat = lambda c: pc.list_flatten(parts[c]).to_numpy()
    return got["y"].to_numpy(), flat("buckets").reshape(n, 2).astype(np.int64), flat("stats").reshape(n, STATS), Sparse(np.repeat(np.arange(n, dtype=np.int32), sizes), flat("number").astype(np.int32), flat("value").astype(np.float32), n)


def _columns(docs: DataFrame) -> list:
    has = lambda c, t: F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)
    return [has("text", "string").alias("text"), has("source", "string").alias("source"), has("lang", "string").alias("lang"), has("n_chars", "long").alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED, pool: int = POOL, rounds: int = 4, layout: bool = True) -> CoTrained | None:
    """Co-trained views from at most labelled rows with labels and pool rows without, those whose ids hash lowest.

    A document with several labels counts as good if at least half of them are; null labels and ids are left out; of several rows of
    one id one is learnt from, so the samples are bounded whatever repeats. None without labels of both classes. layout: whether the metadata view
    has statistics of the layout besides source, language and length.
    """
    judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("q"))
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    h = F.xxhash64("id").alias("h")
    known = ids.join(judged, "id").select("id", h, (F.col("q") >= 0.5).cast("int").alias("y")).distinct().orderBy("h", "id").limit(labelled)
    rest = ids.join(judged, "id", "left_anti").select("id", h, F.lit(-1).alias("y")).distinct().orderBy("h", "id").limit(pool)
    chosen = F.broadcast(known.unionByName(rest))  # at most labelled + pool rows
    sample = docs.select(F.col(id_col).alias("of"), *_columns(docs)).join(chosen, F.col("of") == F.col("id"))
    first = F.row_number().over(W.partitionBy("h", "id").orderBy(F.xxhash64("text", "source", "lang", "n_chars")))
    sample = sample.withColumn("nth", first).where("nth = 1").select("h", "y", "text", "source", "lang", "n_chars")
    small_steps()
    y, buckets, stats, content = _sample_features(sample)
    give_back()
    model = co_train(content, buckets, stats, y, rounds, layout=layout) if len(y) else None
    del y, buckets, stats, content
    give_back()
    return model


def classify(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """docs with p_content, p_metadata, p_quality and keep (p_quality >= threshold); columns of these names are replaced.

    Null and empty texts are judged by their metadata and by having no words; null metadata is a value of its own;
    a missing text, source, lang or n_chars column is null. Without a model every probability is null and all rows are kept.
    """
    out = ["p_content", "p_metadata", "p_quality", "keep"]
    docs = docs.drop(*out)
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in out[:3]}).withColumn("keep", F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM + META + a few numbers
    n = len(docs.columns)

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, n, STEP)):
            a, m = shared.value.views(*(b.column(n + k) for k in range(4)))
            p = logistic(shared.value.combined(a, m))
            more = [pa.array(logistic(a)), pa.array(logistic(m)), pa.array(p), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *more], [*b.schema.names[:n], *out])

    schema = StructType(list(docs.schema.fields))
    for c in out[:3]:
        schema.add(c, "double")
    view = docs.select(*docs.columns, *[c.alias(f"_view{k}") for k, c in enumerate(_columns(docs))])
    return view.mapInArrow(lean(run), schema.add("keep", "boolean"))
