"""Texts whose sets of shingles have a given Jaccard similarity, found by fingerprints and verified on the whole sets.

Each distinct set has two independent SimHashes of the text's distinct words and one of its shingles. Sets are candidates if either of the first differs in
at most WORD_BITS bits (found by pigeonring chain keys) and the last in at most SET_BITS: a word that changes takes
several shingles along but one word, so that similar texts nearly agree in their words, while texts that only have their vocabulary in
common are far apart in their shingles. For sets of few shingles, whose SimHashes a single word turns, the
fingerprint is exact instead: 64 parities, one for each class of shingle hashes, differ in no more bits than the sets differ in shingles, which
is at most WORD_BITS for similar sets of fewer than 90 shingles together.

A pair of candidates belongs to the first of its common chain keys. In a key's bucket, members with few candidates of their own are verified
against all of these. The others are dense: they are verified against centres first, which are close to the majority of the
bucket; then, as long as candidates are in different components, against 15 centres more, 240, and so on, after a bound
by many parities has left out what cannot be similar. No candidate pair stays unverified unless verified links connect it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._graph import connected_components
from ._pigeonring import buckets, chain_keys, chain_length, first_meeting, signed
from ._shared import forget, release_shuffles, written
from ._words import Words, binaries, lean, slices

STEP = 1 << 20  # bytes of text that are worked on at a time
WORD_BITS, SET_BITS = 9, 20
EXACT, SHORT = 50, 40  # sets of fewer shingles than EXACT have exact fingerprints, of fewer than SHORT no others
WIDE = 256  # bytes of parities that a set of SHORT shingles or more has besides
FEW, GROWTH = 4, 64  # candidates that a member is verified against at once; by how much centres grow
BITS_AT_ONCE = 1 << 14
ROWS, WHOLE = 512, 8192  # members that are compared at a time; larger buckets have centres only
BROADCAST_IDS = 400_000  # ids of eight bytes; more are joined by exchange
FAMILIES = 4  # kinds of fingerprint, at most
WORDS_OF, PARITY_OF, AGAIN_OF = 0, 1, 2
ENTRY = "bucket long, tag long, code long, other long, key long"
ENTRY_TYPES = [pa.int64()] * 5


def shingle_sets(texts: pa.Array, width: int, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and where each text's begin (one more at the end).

    A text of fewer words than width is one shingle; null and wordless texts have none. The case of A-Z is ignored.
    """
    from xxhash import xxh3_64_intdigest

    w = words or Words(pc.ascii_lower(texts.cast(pa.string())))
    at, h = w.windows(width, 0)
    doc = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = [xxh3_64_intdigest(b" ".join(w.data[w.start[k] : w.end[k]].tobytes() for k in range(w.first[d], w.first[d + 1]))) for d in short.tolist()]
        doc, h = np.concatenate((doc, short)), np.concatenate((h, np.array(whole, np.uint64)))
    return _distinct(doc, h, len(texts))


def _distinct(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(rows + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set as a whole."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], np.uint64).view(np.int64)


def majorities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each set: the bits that over half of its hashes have; of an empty one 0."""
    rows = len(first) - 1
    counts, n = np.zeros((rows, 64), np.int64), np.diff(first)
    for a in range(0, len(h), BITS_AT_ONCE):
        part = h[a : a + BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        doc = np.searchsorted(first, np.arange(a, a + len(part)), "right") - 1
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
        counts[doc[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8") if rows else np.zeros(0, np.uint64)


def with_set_key(docs: DataFrame, text_col: str, width: int, name: str) -> DataFrame:
    """docs and the set key of each row's text."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, at, STEP)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(set_keys(*shingle_sets(b.column(at), width)))], [*b.schema.names, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, LongType())]))


def described(rows: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, key, n, words, again, set, parity, wide): the set's hash and size, two SimHashes of its words, one of itself, parities of few hash classes and of many."""

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, 1, STEP)):
            w = Words(pc.ascii_lower(b.column(1).cast(pa.string())))
            h, first = shingle_sets(b.column(1), width, w)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            parity = np.zeros(len(n), np.uint64)
            if len(h):
                parity[n > 0] = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), first[:-1][n > 0])
            long = np.flatnonzero(n >= SHORT)
            wide = np.zeros(len(long) * WIDE, np.uint8)
            x, at = h[n[doc] >= SHORT], np.repeat(np.arange(len(long)), n[long])
            np.bitwise_xor.at(wide, at * WIDE + ((x >> np.uint64(3)) % np.uint64(WIDE)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
            ends = np.concatenate(([0], np.cumsum(n >= SHORT))).astype(np.int32) * WIDE
            wide = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(wide)])
            numbers = [x.view(np.int64) for x in (*(majorities(*_distinct(w.doc, w.hashes(k), len(n))) for k in (0, 1)), majorities(h, first), parity)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(set_keys(h, first)), pa.array(n.astype(np.int32)), *map(pa.array, numbers), wide], ["id", "key", "n", "words", "again", "set", "parity", "wide"])

    return rows.mapInArrow(lean(run), "id long, key long, n int, words long, again long, set long, parity long, wide binary")


def entries(texts: DataFrame, keys: list) -> DataFrame:
    """Each set in the buckets of its chain keys; tag holds its size, the fingerprint's kind and the key's."""

    def of(family: int, code: str, rows: DataFrame) -> DataFrame:
        tag = lambda k: F.col("n").cast("long") * (FAMILIES * 256) + (family * 256 + k)
        bucket = lambda k, mask: F.xxhash64(F.lit(family * 256 + k), F.col(code).bitwiseAND(F.lit(signed(mask)))).bitwiseAND(F.lit((1 << 40) - 1))
        each = [F.struct(bucket(k, mask).alias("bucket"), tag(k).alias("tag")) for k, (mask, _) in enumerate(keys)]
        return rows.select(F.explode(F.array(*each)).alias("e"), F.col(code).alias("code"), F.col("set").alias("other"), "key").select("e.bucket", "e.tag", "code", "other", "key")

    long, short = texts.where(F.col("n") >= SHORT), texts.where(F.col("n") < EXACT)
    return of(WORDS_OF, "words", long).unionByName(of(AGAIN_OF, "again", long)).unionByName(of(PARITY_OF, "parity", short))


class Bucket:
    """Members of one bucket, and which of them are candidates that belong to it."""

    def __init__(self, columns, keys: list, similarity: float):
        self.tag, self.code, self.other, self.key = columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64), columns[3]
        self.n, self.keys, self.apart = self.tag // (FAMILIES * 256), keys, (1 - similarity) / (1 + similarity)
        self.least = similarity / (1 + similarity)
        self.kinds = self.tag % (FAMILIES * 256)  # hashes of two kinds of key may agree: then they share a bucket, but no candidates

    def candidates(self, rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows and of that are candidates; both ways if both are on either side, and none with itself."""
        d = self.code[rows, None] ^ self.code[None, of]
        i, j = np.nonzero(np.bitwise_count(d) <= WORD_BITS)
        d, i, j = d[i, j], rows[i], of[j]
        both = self.n[i] + self.n[j]
        ok = (i != j) & (self.kinds[i] == self.kinds[j]) & (np.minimum(self.n[i], self.n[j]) >= self.least * both - 1e-6)
        words = self.kinds[i] // 256 != PARITY_OF
        ok &= np.where(words, np.bitwise_count(self.other[i] ^ self.other[j]) <= SET_BITS, np.bitwise_count(d) <= both * self.apart + 1e-6)
        d, i, j = d[ok], i[ok], j[ok]
        own = np.zeros(len(d), bool)
        for kind in np.unique(self.kinds[i]) if len(i) else ():
            of_kind = np.flatnonzero(self.kinds[i] == kind)
            own[of_kind] = first_meeting(d[of_kind], self.keys, int(kind) % 256, WORD_BITS)
        return i[own], j[own]

    def central(self, some: np.ndarray) -> np.ndarray:
        """Members, those nearest to the majority of their shingles' SimHashes first."""
        bits = np.unpackbits(self.other[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(some), bitorder="little").view("<u8")[0]
        return some[np.lexsort((self.key[some], np.bitwise_count(self.other[some] ^ middle)))]


def _first_round(keys: list, similarity: float):
    """Entries to candidate pairs (a, b), and the entries of dense members with their places among the centres."""

    def one(h, *columns):
        bucket, size = Bucket(columns, keys, similarity), len(h)
        every, degree = np.arange(size), np.zeros(size, np.int64)
        pairs, dense = [], every
        if size <= WHOLE:
            found = [bucket.candidates(every[a : a + ROWS], every) for a in range(0, size, ROWS)]
            for i, _ in found:
                degree += np.bincount(i, minlength=size)
            for i, j in found:
                now = (i < j) & (np.minimum(degree[i], degree[j]) <= FEW)
                pairs.append((i[now], j[now]))
            dense = np.flatnonzero(degree > FEW)
        order = bucket.central(dense) if len(dense) else dense
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (every[:0], every[:0])
        return bucket.key[i], bucket.key[j], [x[order] for x in (h, *columns)], np.arange(len(order))

    def run(batches):
        for group in _gathered(one(*x) for x in buckets(batches)):
            a, b, members, at = zip(*group)
            yield _found(np.concatenate(a), np.concatenate(b), [np.concatenate(x) for x in zip(*members)], np.concatenate(at))

    return run


def _gathered(found, most: int = 1 << 16):
    """Lists of results with about so many rows together."""
    held, rows = [], 0
    for x in found:
        held.append(x)
        rows += len(x[0]) + len(x[3])
        if rows >= most:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _found(a: np.ndarray, b: np.ndarray, members: list, at: np.ndarray) -> pa.RecordBatch:
    m, k = len(a), len(at)
    low, high = np.minimum(a, b), np.maximum(a, b)
    columns = [pa.concat_arrays([pa.nulls(m, t), pa.array(x, t)]) for x, t in zip([*members, at], [*ENTRY_TYPES, pa.int32()])]
    pairs = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(k, pa.int64())]) for x in (low, high)]
    return pa.RecordBatch.from_arrays([*columns, *pairs], [*(c.split()[0] for c in ENTRY.split(", ")), "at", "a", "b"])


def _later_round(keys: list, similarity: float, lo: int, hi: int):
    """Labelled entries of dense members to the pairs of the centres from lo to hi with candidates in other components, and the
    entries that have candidates in other components beyond these."""

    def one(h, tag, code, other, key, at, label, wide):
        names, which = np.unique(label, return_inverse=True)
        none = (key[:0], key[:0], [x[:0] for x in (h, tag, code, other, key)], at[:0])
        if len(names) < 2:
            return none
        bucket = Bucket((tag, code, other, key), keys, similarity)
        has, bits = np.array([len(x) > 0 for x in wide]), np.zeros((len(key), WIDE // 8), np.uint64)
        bits[has] = np.frombuffer(b"".join(wide.tolist()), np.uint64).reshape(-1, WIDE // 8)
        most = np.bincount(which).argmax()
        some = np.flatnonzero(which != most)  # of candidates in different components one at least is among these
        every, pairs, open_ = np.arange(len(key)), [], np.zeros(len(key), bool)
        for a in range(0, len(some), ROWS):
            i, j = bucket.candidates(some[a : a + ROWS], every)
            ok = (label[i] != label[j]) & (np.minimum(at[i], at[j]) >= lo)
            i, j = i[ok], j[ok]
            for c in range(0, len(i), 1 << 14):  # what so many parities show to be too far apart is settled
                x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                far = has[x] & has[y] & (np.bitwise_count(bits[x] ^ bits[y]).sum(1) > (bucket.n[x] + bucket.n[y]) * bucket.apart + 1e-6)
                x, y = x[~far], y[~far]
                now = np.minimum(at[x], at[y]) < hi
                pairs.append((x[now], y[now]))
                open_[x[~now]] = open_[y[~now]] = True
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (every[:0], every[:0])
        once = np.unique(np.stack((np.minimum(i, j), np.maximum(i, j)), 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        kept = np.flatnonzero(open_)
        return key[once[:, 0]], key[once[:, 1]], [x[kept] for x in (h, tag, code, other, key)], at[kept]

    def run(batches):
        for group in _gathered(one(*x) for x in buckets(batches)):
            a, b, members, at = zip(*group)
            yield _found(np.concatenate(a), np.concatenate(b), [np.concatenate(x) for x in zip(*members)], np.concatenate(at))

    return run


def _sets(width: int):
    """(id, text) to (key, runs): the shingle hashes, packed."""

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, 1, STEP)):
            h, first = shingle_sets(b.column(1), width)
            runs = [h[a:e].tobytes() for a, e in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(h, first)), pa.array(runs, pa.binary())], ["key", "runs"])

    return run


def _similar(similarity: float):
    def run(batches):
        for b in (x for batch in batches for x in slices(batch, 2, 1 << 23)):
            keep = []
            for x, y in zip(binaries(b.column(2)), binaries(b.column(3))):
                x, y = x.view(np.uint64), y.view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _not_far(similarity: float):
    """Drops pairs that the parities of many hash classes show to differ in more shingles than similar sets can."""

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            both = [(x, y) if x and y else (b"", b"") for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            apart = np.array([(int.from_bytes(x) ^ int.from_bytes(y)).bit_count() for x, y in both], np.int64)
            yield b.filter(pa.array(apart <= n * (1 - similarity) / (1 + similarity) + 1e-6)).select(["a", "b"])

    return run


def verified(rows: DataFrame, texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs of keys whose sets are similar, a written table; a key's set is made of a row of the least id that has it."""
    release_shuffles(rows.sparkSession)
    side = lambda c: texts.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    near = written(both.mapInArrow(lean(_not_far(similarity)), "a long, b long"), "near-enough")
    keys = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    members = written(texts.join(keys, "key").select(F.col("least").alias("member")).distinct(), "members")
    some = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    sets = rows.join(some, rows.id == F.col("member")).select("id", "text").mapInArrow(lean(_sets(width)), "key long, runs binary")
    sets = sets.dropDuplicates(["key"])  # not written: both sides of the join read the one exchange
    side = lambda c: sets.select(F.col("key").alias(c), F.col("runs").alias(f"runs_{c}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "runs_a", "runs_b")
    similar = written(both.mapInArrow(lean(_similar(similarity)), "a long, b long"), "similar")
    forget(near, members)
    return similar


def similar_components(rows: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows: (id, text), ids not null. (id, key) of each row, and (key, root, component_id) of each key: keys of one root are what
    similar pairs connect, component_id is the smallest id of theirs."""
    spark = rows.sparkSession
    each = written(described(rows, width), "described")
    numbers = ("n", "words", "again", "set", "parity", "wide")
    texts = written(each.groupBy("key").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in numbers)), "texts")
    keys = chain_keys(WORD_BITS, chain_length(texts.count(), WORD_BITS))
    dealt = lambda df, *by: df.repartition("bucket").sortWithinPartitions("bucket", *by)
    found = f"{ENTRY}, at int, a long, b long"
    fields = [c.split()[0] for c in ENTRY.split(", ")]
    now = written(dealt(entries(texts, keys), "key").mapInArrow(lean(_first_round(keys, similarity)), found), "candidates")
    links, lo, hi = None, 0, 1
    while True:
        more = verified(rows, texts, now.where("a is not null").select("a", "b").distinct(), width, similarity)
        links = more if links is None else links.unionByName(more)
        comp = written(connected_components(spark, links), "components")
        dense = now.where("at is not null").select(*fields, "at")
        if dense.isEmpty():
            break
        labelled = dense.join(comp, dense.key == comp.node, "left").select(*fields, "at", F.coalesce("root", "key").alias("label"))
        labelled = labelled.join(texts.select("key", "wide"), "key").select(*fields, "at", "label", "wide")
        later = written(dealt(labelled, "at").mapInArrow(lean(_later_round(keys, similarity, lo, hi)), found), "candidates")
        forget(now, comp)
        now, lo, hi = later, hi, hi * GROWTH
    forget(now)
    rooted = texts.join(comp, texts.key == comp.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.select("id", "key"), rooted.join(named, "root").select("key", "root", "component_id")
