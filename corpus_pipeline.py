"""The corpus pipeline: documents to a mixed, tokenised training set.

Each stage calls one operator of tarnql.llm on all that its predecessor kept. STAGES lists (name, function); a function
takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents for all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import cotraining, mixing, personal_data, pieces, simhash
from tarnql.llm._shared import forget, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.classify(docs, model).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.dedup_near_copies(docs, shingle=5, similarity=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; n_chars follows the text."""
    out = personal_data.find_personal_data(docs, redact=True)
    changed = F.col("spans") != ""
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("redact", redact), ("mix", mix), ("tokenise", tokenise)]

#: SQL has no classifier, SimHash or tokeniser; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
