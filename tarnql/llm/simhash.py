"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprints of at most t differing bits share a chain key (_pigeonring). They meet in its bucket, and links that span
what they form come out. The operator on fingerprints has the relation of the fingerprints alone; near copies of texts are
found the same way and then verified on the sets of their shingles (similar_sets).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._pigeonring import BITS, buckets, chain_keys, chain_length, signed, within_chain
from ._shared import unused, written
from .similar_sets import similar_components, with_set_key

BLOCK = 1 << 15


def text_fingerprint(data: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if over half of the shingles' XXH64 have it; no words give 0."""
    from xxhash import xxh64_intdigest

    words = data.lower().split() if data else []  # on bytes both know ASCII only: A-Z, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        cut = map(slice, starts[k : min(n, k + BLOCK)].tolist(), ends[min(shingle, len(words)) - 1 :][k : k + BLOCK].tolist())
        h = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cut), repeat(seed)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint's 64 bits as a signed long, 0 for null or wordless texts."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([text_fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def _forest(x: np.ndarray, prefix: tuple[int, ...], threshold: int):
    """Links that span what a bucket's distinct fingerprints form: each is held once against those not yet reached."""
    rest = x
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            a = front.pop()
            d = rest ^ a
            ok = within_chain(d, prefix, threshold)
            ok[ok] = np.bitwise_count(d[ok]) <= threshold
            for b in rest[ok]:
                yield a, b
                front.append(b)
            rest = rest[~ok]


def link_forest(fps: DataFrame, threshold: int, length: int) -> DataFrame:
    """Pairs (a, b) of fp values at most threshold bits apart that connect whatever such pairs connect.

    fps: distinct values. Each goes to all its chain keys; a bucket is read as one sorted run of 8-byte values, and at
    most one pair less than it has values comes out of it.
    """
    keys = chain_keys(threshold, length)
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for k, (mask, _) in enumerate(keys)])
    rows = fps.select("fp", F.explode(entries).alias("e")).select("e.kind", "e.key", "fp")

    def run(batches):
        pairs = []
        for kind, _, fp in buckets(batches, 2):
            pairs += _forest(fp.view(np.uint64), keys[kind[0]][1], threshold)
            if len(pairs) >= 1 << 16:
                yield found(pairs)
                pairs = []
        yield found(pairs)

    def found(pairs):
        p = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, threshold: int = 4) -> DataFrame:
    """One row per input row: the id, its fingerprint fp (64 bits as a signed long) and component_id.

    Two rows are linked if their fingerprints differ in at most threshold bits; component_id is the smallest id that
    links can reach, the row's own included. Nulls, empty and wordless texts have fingerprint 0 and are linked like
    any others; a text of fewer words than a shingle is one shingle. Rows with a null id are linked and get their
    component's smallest id, or null if it has none. Repeated rows stay. Other columns are not looked at. Equal
    fingerprints are folded before anything is paired, so copies never meet each other.
    """
    spark = docs.sparkSession
    each = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    known = written(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    links = link_forest(known.select("fp"), threshold, chain_length(known.count(), threshold))
    comp = connected_components(spark, links)
    known = known.join(comp, known.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = known.join(named, "root").select("fp", "component_id")
    return each.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row with an id: the id and component_id, the smallest id that links can reach.

    Two texts are linked if they are candidates by their fingerprints (similar_sets) and the Jaccard similarity of their sets of shingle words is similarity or
    more. Every candidate is verified unless other links connect it already. For texts of fewer than 50 shingles candidates are all similar
    ones; of longer similar texts some few in a hundred differ in more words than the fingerprints allow and may stay apart (README). Null, empty and
    wordless texts are one class; of fewer words than a shingle, the whole is one. Rows with a null id take no part. Ids are integers.
    """
    each, classes = similar_components(_identified(docs, id_col, text_col), shingle, similarity)
    return each.join(classes, "key").select(F.col("id").alias(id_col), "component_id")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def dedup_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their class (near_duplicate_classes), and those with a null id.

    Of rows of one class with one id one is kept, whichever comes first; rows with one id whose texts are of different classes are judged
    apart. An empty table gives no rows. Columns of any name pass through.
    """
    each, classes = similar_components(_identified(docs, id_col, text_col), shingle, similarity)
    rows = written(each.join(classes, "key").select("id", "key", "root", "component_id"), "classes")
    key, i, k, r = unused(docs, "_set_key", "_id", "_of", "_root")
    gone = rows.where("component_id < id").select(F.col("id").alias(i), F.col("key").alias(k)).distinct()
    same = (F.col(id_col).cast("long") == F.col(i)) & (F.col(key) == F.col(k))
    kept = with_set_key(docs, text_col, shingle, key).join(gone, same, "left_anti")
    several = rows.groupBy("id").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("id")
    marked = rows.join(several, "id").select(F.col("id").alias(i), F.col("key").alias(k), F.col("root").alias(r)).distinct()
    named = kept.where(F.col(id_col).isNotNull()).join(marked, same, "left")
    one = named.dropDuplicates([id_col, r]).select(*docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
