"""The corpus pipeline: language, near-duplicates, pseudonyms, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; `run` writes each
result as Parquet into the session's shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.llm.jaccard import judged_rows
from trailmill.llm.langid import UNDETERMINED, identify
from trailmill.llm.packing import pack_documents
from trailmill.llm.pii import pseudonymise_documents
from trailmill.session import cut

#: Score of a text on the border of the best one-versus-rest classifier.
ACCEPTED = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language nothing vouches for go, and a missing `lang` becomes the predicted one.

    These are documents without text or letters (`und`), and those that no one-versus-rest
    classifier accepts (a score below `ACCEPTED`) while their label is another or missing.
    The rest are as they were.
    """
    found = identify(docs.select(*COLUMNS), list(COLUMNS)).where(F.col("lang_pred") != UNDETERMINED)
    named = F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(False))
    kept = found.where((F.col("lang_score") >= ACCEPTED) | named)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: one with the smallest doc_id.

    Rows are judged by their own text, not by their id: a row with a null doc_id links with
    nothing and stays, a row that repeats a doc_id with an unlike text stays where that text
    would, and of rows equal in doc_id and set of shingles one stays.
    """
    docs = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    rows = judged_rows(docs).where("doc_id = component_id")
    kept = cut(rows.groupBy("doc_id", "node").agg(F.min("text_key").alias("text_key"), F.count("*").alias("rows")), "kept")
    named = docs.join(kept.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")
    if not kept.where("rows > 1").isEmpty():
        repeat = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("lang", "source", "n_chars"))
        named = named.withColumn("repeat", repeat).where("repeat = 1")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars is counted again."""
    done = pseudonymise_documents(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left and their places in sequences of 1024 ids."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", pii), ("pack", pack)]

#: The stages need kernels, hashing and tokenizers that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
