"""Read workloads: sequential scans and random reads by key."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .database import Database
from .files import SEED

#: Part of the reads that go to a random row instead of the next one, by mode; mode 1 scans.
MODES = {1: None, 2: 0.2, 3: 0.5, 4: 0.8}


@dataclass
class Reading:
    rows: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.rows / max(self.seconds, 1e-9)


def random_reads(rows: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """For each row one read: of the row itself, or for fraction of them of another row that is chosen at random.

    Rows are numbered from 0 over all partitions: where a partition begins is a running sum of the partitions' counts, which is joined by
    partition. Reads and rows then meet in one join by number, so a read is a lookup in a distributed table and not one
    request after the other.
    """
    placed = rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return rows.limit(0)
    begin = F.sum("n").over(W.orderBy("_part")) - F.col("n")  # a row for each partition
    numbered = placed.join(counts.select("_part", begin.alias("_begin")), "_part").withColumn("_row", F.col("_begin") + F.col("_place")).drop("_part", "_place", "_begin")
    at = F.when(F.rand(seed) < fraction, F.floor(F.rand(seed + 1) * total).cast("long")).otherwise(F.col("_row"))
    reads = numbered.select(at.alias("_row"))
    return reads.join(numbered, "_row").select(*rows.columns)


def run_workload(db: Database, relations: Sequence[str], mode: int) -> Reading:
    """Reads all rows of the relations once in a mode of MODES, and counts and times it."""
    fraction, rows, began = MODES[mode], 0, time.time()
    for name in relations:
        df = db.df(name)
        rows += (df if fraction is None else random_reads(df, fraction)).count()
    return Reading(rows, time.time() - began)
