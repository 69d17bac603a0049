"""Pipe-separated text files as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import Schema

SEED = 12345


def read_pipe_text(spark: SparkSession, path: str, schema: Schema, fraction: float = 1.0, seed: int = SEED) -> DataFrame:
    """Rows of a file or folder without header, quotes or escapes; further fields of a line are dropped, either line end will do.

    Days are written YYYY-MM-DD or YYYYMMDD. A value that is no value of its type, or missing, is an error when it is read. fraction
    keeps a random part of the rows, the same in every run.
    """
    lines = spark.read.text(path)
    parts = F.split(F.regexp_replace("value", "\r$", ""), r"\|", -1)
    columns = []
    for k, (f, t) in enumerate(zip(schema.fields, schema.types)):
        text = F.element_at(parts, k + 1)
        if t.kind == "date":
            column = F.to_date(F.replace(text, F.lit("-"), F.lit("")), "yyyyMMdd")
        else:
            column = text.cast({"int": "long", "float": "double"}.get(t.kind, "string"))
        columns.append(t.stored(column).alias(f))
    rows = lines.select(*columns)
    return rows if fraction >= 1 else rows.sample(fraction=fraction, seed=seed)


def read_table_files(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A relation from files of any format Spark reads."""
    return spark.read.format(kind).options(**options).load(path)


def file_headers(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A row for each file behind a DataFrame: path, bytes and rows, the rows from the scan's own counts and no column read."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
