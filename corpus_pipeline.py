"""Raw documents to training sequences, in stages: language, quality, near-duplicates, packing.

A stage is a function of (spark, docs, sf_dir). Each works on all that the stage before kept;
between stages the documents are written as Parquet in the shared folder and read again, so
that a lost executor costs its own tasks and no earlier stage.
"""

from __future__ import annotations

from public_tokenizers import path as public_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.llm import langid, packing, quality, simhash
from cantera.session import new_path, shared_folder, ship

# A text whose language is less likely than this is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no clear language; columns stay."""
    ship(spark)
    shared_folder(spark)
    model = langid.learn(docs.where(~langid.is_held_out()), public_file("piece_bpe_32k.model"))
    told = langid.identify(docs, model)
    clear = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    # Without any labelled row nothing can be told, and nothing but a missing letter is held against a text.
    if not model.languages:
        clear = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return told.where(clear).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base rules or lie beyond the fences of their group; columns stay."""
    shared_folder(spark)
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates; columns stay.

    Prints of three-word shingles that differ in at most two bits are linked, as in `op1_simhash`.
    """
    ship(spark)
    shared_folder(spark)
    return simhash.without_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; see `packing.pack`."""
    ship(spark)
    shared_folder(spark)
    return packing.pack(docs, public_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

# Neither the language model nor shingle hashes and token ids can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
