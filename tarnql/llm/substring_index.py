"""Substring deduplication against a log-structured index of window hashes.

The index is a set of sorted immutable runs. A run holds, for each bucket (a range of the 64-bit window hash), the
ascending hashes of windows that its documents brought in, each with a 32-bit check from a second, independent function. A
new batch of documents is hashed, folded to one entry for each window and Arrow batch, exchanged once by bucket, and
merge-joined with every run of its bucket: an entry is known if a run has its hash and the check verifies it. What was
not known becomes the batch's own run. Runs are kept in one bucketed table, so joining and compacting never move
history between executors; when there are fanout runs they are merged into one. Together hash and check have 96 bits: among
10 ** 14 windows less than one false match is to be expected.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import delete_path, fresh_path, release_shuffles
from ._words import Words, mix

BUCKET_BYTES = 6_000_000  # of a batch's texts for each bucket, about a million windows
MOST_BUCKETS, MOST_BYTES = 4096, 24_000_000  # buckets at most, and bytes of a batch's texts for each once there are so many
GROUP_BYTES = 6_000_000  # of texts for each group
CELL = "bucket int, kind string, doc_id long, n int, h binary, c binary, docs binary"


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: in sorted differences the high planes are nearly all zero."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    from zstandard import ZstdDecompressor

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _rising(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _groups(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)])) if len(x) else np.zeros(1, np.int64)


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 7, kinds)], [c.split()[0] for c in CELL.split(", ")])


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _flags(bucket: int | None, groups: int, doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """For each group of documents one row with the hashes of their windows that occur earlier."""
    group = _group_of(doc, groups)
    order = np.lexsort((h, doc, group))
    group, doc, h = group[order], doc[order], h[order]
    cuts, rows = _groups(group), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        each = _groups(doc[a:b])
        ids = np.ascontiguousarray(doc[a:b][each[:-1]])
        g = int(group[a])
        rows.append((g % (1 << 31) if bucket is None else bucket, "flag", g, int(b - a), _pack(np.ascontiguousarray(h[a:b])), None, _join(_pack(np.diff(each).astype(np.uint32)), _pack(_rising(ids)))))
    return _cells(rows)


def _fold(h: np.ndarray, c: np.ndarray, doc: np.ndarray):
    """Sorted by (h, c, doc): the first entry of each (h, c), and of the others those of another document than the first's."""
    order = np.lexsort((doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    lead = np.flatnonzero(new)
    late = doc != doc[lead[np.cumsum(new) - 1]] if len(h) else new
    return (h[lead], c[lead], doc[lead]), (h[late], doc[late])


def _entries(width: int, bits: int, groups: int, step: int = 1 << 22):
    """Documents to cells: for each step and bucket one of kind batch, and of kind flag what an earlier document of the step has."""

    def some(batch):
        words = Words(batch.column(1))
        at, h = words.windows(width, 0)
        _, c = words.windows(width, 1)
        doc = batch.column(0).to_numpy()[words.doc[at]]
        (h, c, doc), (late_h, late_doc) = _fold(h, (c >> np.uint64(32)).astype(np.uint32), doc)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
        cuts = _groups(bucket)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            ids, which = np.unique(doc[a:b], return_inverse=True)
            small = which.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
            rows.append((int(bucket[a]), "batch", len(ids), int(b - a), _pack(_rising(h[a:b])), _pack(c[a:b]), _join(_pack(small), _pack(_rising(ids)))))
        yield _cells(rows)
        if len(late_h):
            yield _flags(None, groups, late_doc, late_h)

    def run(batches):
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(b):  # about step bytes of text at a time, whole rows
                e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step)))
                yield from some(b.slice(a, e - a))
                a = e

    return run


def _join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _split(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:4], "little")
    return x[4 : 4 + n], x[4 + n :]


def _known(h: np.ndarray, c: np.ndarray, run_h: np.ndarray, run_c: np.ndarray) -> np.ndarray:
    """Merge join of two sorted runs: which (h, c) the second has. Equal hashes with other checks are passed over."""
    at = np.searchsorted(run_h, h)
    found, going = np.zeros(len(h), bool), np.arange(len(h))
    while len(going):
        going = going[at[going] < len(run_h)]
        going = going[run_h[at[going]] == h[going]]
        same = run_c[at[going]] == c[going]
        found[going[same]] = True
        going = going[~same]
        at[going] += 1
    return found


def _run_cell(bucket: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return _cells([(bucket, "run", None, len(h), _pack(_rising(h)), _pack(c), None)])


def _merge(groups: int):
    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        """One bucket of a batch against the runs of the index: new run, and flags for entries that are known or late."""
        out, hs, cs, docs = [], [], [], []
        for r in left.filter(pc.equal(left["kind"], "batch")).to_pylist():
            which, ids = _split(r["docs"])
            ids = np.cumsum(_unpack(ids, np.int64))
            hs.append(np.cumsum(_unpack(r["h"], np.uint64), dtype=np.uint64))
            cs.append(_unpack(r["c"], np.uint32))
            docs.append(ids[_unpack(which, np.uint16 if r["doc_id"] < 1 << 16 else np.uint32)])
        out += left.filter(pc.equal(left["kind"], "flag")).to_batches()
        if hs:
            bucket = left["bucket"][0].as_py()
            (h, c, doc), (late_h, late_doc) = _fold(*map(np.concatenate, (hs, cs, docs)))
            known = np.zeros(len(h), bool)
            for r in right.select(["h", "c"]).to_pylist():
                known |= _known(h, c, np.cumsum(_unpack(r["h"], np.uint64), dtype=np.uint64), _unpack(r["c"], np.uint32))
            late_h, late_doc = np.concatenate((late_h, h[known])), np.concatenate((late_doc, doc[known]))
            if len(late_h):
                out.append(_flags(bucket, groups, late_doc, late_h))
            if not known.all():
                out.append(_run_cell(bucket, h[~known], c[~known]))
        return pa.Table.from_batches(out or [_cells([])])

    return merge


def _compact(cells: pa.Table) -> pa.Table:
    """The runs of one bucket as one run; windows of different runs differ."""
    rows = cells.select(["bucket", "h", "c"]).to_pylist()
    h = np.concatenate([np.cumsum(_unpack(r["h"], np.uint64), dtype=np.uint64) for r in rows])
    c = np.concatenate([_unpack(r["c"], np.uint32) for r in rows])
    order = np.lexsort((c, h))
    return pa.Table.from_batches([_run_cell(rows[0]["bucket"], h[order], c[order])])


def plan_sizes(size: int, batches: int = 4) -> tuple[int, int]:
    """Buckets and batches for size bytes of text: buckets of about a million windows of a batch up to MOST_BUCKETS, then buckets of up to four million,
    then more batches. So what a task holds is bounded, a step of texts makes at most MOST_BUCKETS cells, and buckets stay far below Spark's limit."""
    buckets = min(MOST_BUCKETS, max(16, size // (BUCKET_BYTES * batches)))
    return buckets, max(batches, -(-size // (MOST_BUCKETS * MOST_BYTES)))


class WindowIndex:
    """Hashes of all windows of width words seen so far, as runs in the shared folder.

    buckets is a power of two that is fixed for the index: enough of them that a bucket's entries fit into a task.
    groups: flags are returned by group of documents, so many that the texts of one fit into a task.
    Runs have levels: fanout runs of one level are merged into one of the next, so a window is rewritten as often as there are levels, a
    logarithm of the batches.
    """

    def __init__(self, spark: SparkSession, width: int = 13, buckets: int = 64, groups: int = 64, fanout: int = 2):
        self.spark, self.width, self.groups, self.fanout = spark, width, groups, fanout
        self.bits = max(0, (buckets - 1).bit_length())
        self.buckets, self.batches = 1 << self.bits, 0
        self.levels: dict[int, int] = {}  # of each run, by its number
        self._numbers = 0  # of batches and merged runs
        self._create()

    @property
    def runs(self) -> int:
        return len(self.levels)

    def _create(self) -> None:
        self.name, self.path = f"windows_{uuid.uuid4().hex}", fresh_path(self.spark, "windows")
        self.spark.sql(f"CREATE TABLE {self.name} ({CELL}, run int) USING parquet OPTIONS (compression 'uncompressed') PARTITIONED BY (kind, run) CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _append(self, cells: DataFrame, run: int) -> None:
        columns = [c for c in self.spark.table(self.name).columns if c not in ("kind", "run")]
        cells.select(*columns, "kind", F.lit(run).alias("run")).write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _history(self, runs=None) -> DataFrame:
        return self.spark.table(self.name).where((F.col("kind") == "run") & F.col("run").isin(list(self.levels if runs is None else runs)))

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Takes in a batch (id long, text) and returns its flags (grp, h, docs), packed: for each document of a group the hashes
        of windows that are in the index or in a document of the batch with a smaller id. Rows with a null id take no part.

        last: the index will not be used again, and the batch's own run is not kept.
        """
        cells = docs.where("id IS NOT NULL").mapInArrow(_entries(self.width, self.bits, self.groups), CELL)
        old = self._history().drop("run")
        found = cells.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_merge(self.groups), CELL)
        if last:
            found = found.where("kind = 'flag'")
        self.batches = self._numbers = self._numbers + 1
        self._append(found, self.batches)
        schema, part = "doc_id long, h binary, docs binary", f"kind=flag/run={self.batches}"
        flags = self.spark.read.schema(schema).parquet(f"{self.path}/{part}") if self._has(part) else self.spark.createDataFrame([], schema)
        if not last:
            self.levels[self.batches] = 0
            while self.compact():
                pass
        release_shuffles(self.spark)
        return flags.withColumnRenamed("doc_id", "grp")

    def _has(self, part: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def compact(self) -> bool:
        """Merges the runs of the lowest level that has fanout of them into one of the next, bucket by bucket where they are, and deletes them."""
        level = next((x for x in sorted(set(self.levels.values())) if sum(y == x for y in self.levels.values()) >= self.fanout), None)
        if level is None:
            return False
        old = [r for r, x in self.levels.items() if x == level]
        self._numbers += 1
        self._append(self._history(old).drop("run").groupBy("bucket").applyInArrow(_compact, CELL), self._numbers)
        self.levels = {r: x for r, x in self.levels.items() if r not in old} | {self._numbers: level + 1}
        for r in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (kind = 'run', run = {r})")
            delete_path(self.spark, f"{self.path}/kind=run/run={r}")
        return True

    def close(self, flags: bool = True) -> None:
        """Drops the table and deletes the runs; flags that were returned stay readable, unless they are not to be kept."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, f"{self.path}/kind=run" if flags else self.path)


def _remove(width: int):
    def remove(docs: pa.Table, flags: pa.Table) -> pa.Table:
        """A group of documents without the words that its flags mark."""
        marks: dict[int, list[np.ndarray]] = {}
        for r in flags.to_pylist():
            counts, ids = (_unpack(x, t) for x, t in zip(_split(r["docs"]), (np.uint32, np.int64)))
            parts = np.split(_unpack(r["h"], np.uint64), np.cumsum(counts)[:-1])
            for i, part in zip(np.cumsum(ids).tolist(), parts):
                marks.setdefault(i, []).append(part)
        docs = docs.select(["id", "text"]).combine_chunks()
        ids, texts = docs["id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist()
        marked = [k for k, i in enumerate(ids) if i in marks]
        words = Words(pa.array([texts[k] for k in marked], pa.binary()))
        at, h = words.windows(width, 0)
        cuts = np.searchsorted(words.doc[at], np.arange(len(marked) + 1))
        place = {k: j for j, k in enumerate(marked)}
        n_words, n_removed, kept = [], [], []
        for k, text in enumerate(texts):
            parts, gone = (text or b"").split(), 0
            if k in place:
                j = place[k]
                mine = slice(cuts[j], cuts[j + 1])
                hit = at[mine][np.isin(h[mine], np.concatenate(marks[ids[k]]))] - words.first[j]
                edge = np.zeros(len(parts) + 1, np.int64)
                edge[hit] += 1
                edge[hit + width] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                gone = int(len(parts) - stay.sum())
                parts = [parts[x] for x in np.flatnonzero(stay)]
            n_words.append(len(parts) + gone)
            n_removed.append(gone)
            kept.append(b" ".join(parts))
        return pa.table({"id": docs["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return remove


def dedup_substrings(docs: DataFrame, width: int = 13, batches: int = 4, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_words, n_removed and kept, the words that stay, joined by a space.

    A word goes if it lies in a window of width consecutive words that also starts in a document with a smaller id, judged on
    the input. The table is taken in batches of rising ids, each against the index of those before. Null and empty
    texts have no words; a text of fewer than width words keeps all. Rows with a null id keep all and take nothing from
    others; rows with the same id do not take from each other. An empty table gives no rows. Other columns are not looked at.

    buckets: None sizes them, and more than the given batches, by the input (plan_sizes). If a batch fails, the index is deleted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if buckets is None:
        buckets, batches = plan_sizes(size, batches)
    share = [k / batches for k in range(1, batches)]
    bounds = sorted(set(rows.agg(F.percentile_approx("id", share, 10000)).first()[0] or [])) if share else []
    groups = max(16, size // GROUP_BYTES)
    index, flags = WindowIndex(spark, width, buckets, groups), None
    try:
        for k, (a, b) in enumerate(zip([None, *bounds], [*bounds, None])):
            part = rows.where((F.lit(True) if a is None else F.col("id") > a) & (F.lit(True) if b is None else F.col("id") <= b))
            found = index.add(part, last=k == len(bounds))
            flags = found if flags is None else flags.unionByName(found)
    except BaseException:
        index.close(flags=False)
        raise
    index.close()
    grouped = rows.mapInArrow(_with_group(groups), "grp long, id long, text string")
    out = grouped.groupBy("grp").cogroup(flags.groupBy("grp")).applyInArrow(_remove(width), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def _with_group(groups: int):
    def run(batches):
        for b in batches:
            ids = pc.fill_null(b.column(0), 0).to_numpy()
            group = _group_of(ids, groups)
            lost = np.flatnonzero(b.column(0).is_null().to_numpy(zero_copy_only=False))
            group[lost] = [hash_text(x) % groups for x in b.column(1).take(pa.array(lost)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(group), b.column(0), b.column(1)], ["grp", "id", "text"])

    return run


def hash_text(data: bytes | None) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(data or b"")
