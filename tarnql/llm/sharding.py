"""Sharding by histogram sort: even byte counts, rows in the order of (hash of the text, id), one exchange.

Rows have the key (xxhash64 of the text, id). Each round counts the exact bytes below evenly spaced probes in the
interval that still holds a splitter, in all partitions, and narrows every splitter's interval to one of 2 ** STEP
parts. It ends when a splitter's target is within the tolerance of a boundary between two texts; only a group of equal
texts that is larger than the tolerance is cut, by further rounds over the ids. What reaches the driver is at most
2 ** STEP counts for each splitter and round, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import forget, written

STEP = 8
LOW, END = -(1 << 63), 1 << 63


def _counts(rows: DataFrame, key: str, starts: set[int], shift: int) -> dict[int, list[tuple]]:
    """For the interval of width 2 ** (shift + STEP) at each start, in order, its parts that have rows: (start, bytes, rows, least and greatest key)."""
    first = shift + STEP == 64
    inside = F.lit(True) if first else F.shiftright(key, shift + STEP).isin([s >> (shift + STEP) for s in starts])
    got = rows.where(inside).groupBy(F.shiftright(key, shift).alias("part")).agg(F.sum("size"), F.count("*"), F.min(key), F.max(key)).collect()
    out: dict[int, list[tuple]] = {s: [] for s in starts}
    for part, *found in sorted(map(tuple, got)):
        out[LOW if first else part >> STEP << (shift + STEP)].append((part << shift, *found))
    return out


def _refine(rows: DataFrame, key: str, targets: list[int], slack: float) -> list[tuple[int, int, int, int, int]]:
    """For each target the nearest boundary probed and the bytes below it (rows below are those with a smaller key); then
    the least key of the narrowest interval that holds the target, the bytes below that and the rows in it."""
    best: list = [None] * len(targets)
    where = [(LOW, 0)] * len(targets)
    todo = set(range(len(targets)))
    for shift in range(64 - STEP, -1, -STEP):
        counts = _counts(rows, key, {where[t][0] for t in todo}, shift)
        for t in sorted(todo):
            start, below = where[t]
            parts = counts[start]
            for begin, n, count, low, high in parts:
                if below + n > targets[t] or begin == parts[-1][0]:
                    break
                below += n
            ends = [(low, below), (high + 1 if low == high else begin + (1 << shift), below + n)]
            near = min(ends + ([best[t][:2]] if best[t] else []), key=lambda x: abs(x[1] - targets[t]))
            best[t] = (*near, low, below, count)
            where[t] = (begin, below)
            if low == high or abs(near[1] - targets[t]) <= slack:
                todo.discard(t)
        if not todo:
            break
    return best


def even_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """shards - 1 splitters (hash, id). A row is past (hash, None) if its hash is not smaller, and past (hash, id) if its
    hash is larger, or equal with an id that is not smaller.

    rows: (h long, id long, size long), a written table; a round scans it once.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(END, None)] * (shards - 1)
    targets = [total * k // shards for k in range(1, shards)]
    slack = tolerance * total / shards
    out: list[tuple[int, int | None]] = []
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (at, below, inside, before, count) in enumerate(_refine(rows, "h", targets, slack)):
        out.append((at, None))
        if count > 1 and abs(below - targets[k]) > slack:  # then inside is the hash of one group of equal texts
            groups.setdefault((inside, before), []).append(k)
    for (h, before), mine in groups.items():
        group = rows.where(F.col("h") == h).select("size", F.coalesce("id", F.lit(LOW)).alias("id"))
        for k, (at, *_) in zip(mine, _refine(group, "id", [targets[k] - before for k in mine], 0)):
            out[k] = (h, at)
    return out


def _past(h: int, at: int | None):
    if at is None:
        return F.col("h") >= h if h < END else F.lit(False)
    beyond = F.col("h") > h
    return beyond | ((F.col("h") == h) & (F.coalesce("id", F.lit(LOW)) >= at)) if at < END else beyond


def _keys_and_shard(docs: DataFrame, shards: int, id_col: str, text_col: str, tolerance: float) -> tuple[DataFrame, Column]:
    """Narrow rows (id, h, size, text_crc32) of all documents, and the shard as a function of id and h."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "keys")
    splitters = even_splitters(rows, shards, tolerance)
    return rows, sum((_past(*s).cast("int") for s in splitters), F.lit(0)).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, run_rows: int = 2_000_000) -> DataFrame:
    """One row per input row: the id, size (UTF-8 bytes + 1), text_crc32, shard and slot.

    The shards' bytes are equal to within tolerance of a shard, or as near as whole rows allow. Equal texts are
    neighbours in the order and share a shard unless that would break the tolerance. A null text has no bytes (size
    1), a null id comes before all others. slot numbers a shard's rows from 0 in the order of the sort; rows that
    agree in id and text may come in any order, and with one id for very many equal texts, those stay together. An
    empty table gives no rows; other columns are not looked at.

    The text is read once. The exchange is a range partitioning of narrow rows by (shard, hash, id), in as many
    partitions as keep run_rows rows in each.
    """
    spark = docs.sparkSession
    rows, shard = _keys_and_shard(docs, shards, id_col, text_col, tolerance)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // run_rows + 1)
    place = F.monotonically_increasing_id()  # partition and position, of rows sorted just before
    placed = rows.withColumn("shard", shard).repartitionByRange(parts, "shard", "h", "id").sortWithinPartitions("shard", "h", "id").withColumn("place", place)
    placed = written(placed, "placed").withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "part", (before - F.col("first")).alias("shift"))  # at most one row for each part and splitter
    slot = (F.col("place") + F.col("shift")).alias("slot")
    return placed.join(F.broadcast(runs), ["shard", "part"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot)


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01) -> None:
    """Writes docs, all columns, to path/shard=k/: each row goes to the shard shard_by_bytes gives it, which is a function of its id and text.

    Null ids and texts, repeated rows and ties are as there: rows that agree in id and text share a shard. An empty table writes no
    shards. A column called shard is an error, since that is the folder's; other columns may have any name.
    """
    if "shard" in map(str.lower, docs.columns):
        raise ValueError("docs has a column shard, which is the name of the folders")
    rows, shard = _keys_and_shard(docs, shards, id_col, text_col, tolerance)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    out = keyed.select("_row.*", shard.alias("shard"))
    out.repartition("shard", F.pmod(F.xxhash64(id_col, F.xxhash64(text_col)), F.lit(32))).write.partitionBy("shard").parquet(path)
    forget(rows)
