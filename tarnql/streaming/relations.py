"""Streams of files as relations, and query results that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.types import Schema
from ..plans.plan import Plan
from ..sources.database import Database


def attach_stream(db: Database, name: str, path: str, schema: Schema, files_per_trigger: int | None = None) -> DataFrame:
    """Attaches a folder of Parquet files that keeps growing; builder queries over the relation are streaming queries then.

    Filters, projections, unions, joins and groupings with built-in folds work on it. A grouping needs the update or complete mode.
    """
    reader = db.spark.readStream.schema(schema.struct())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path)
    db.attach(name, df, schema)
    return df


def follow(plan: Plan, db: Database, into: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Appends a streaming plan's rows to a relation with the same fields, a batch at a time, until what is there is read."""

    def write(batch: DataFrame, _: int) -> None:
        db.insert(into, batch)

    return plan.df().writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
