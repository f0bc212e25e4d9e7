"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import langid, mixing, neardup, packing, pii
from skyweave.llm.common import small_batches, stored, whole_row
from skyweave.llm.queries import tokenizer_path

#: Calibrated probability below which a text's language is not taken as known.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text has a language that the model knows, with a probability of LEAST_SCORE or more. The result is written here, while batches of texts are small."""
    predicted = langid.predict_languages(docs.select("text", whole_row(docs).alias("row")), langid.fit_languages(docs))
    with small_batches(spark):
        return stored(predicted.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*"), "language_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put kinds in place of personal data; texts without any stay as they are. n_chars follows the text."""
    out = pii.masked(pii.find_pii(docs.select("text", whole_row(docs).alias("row"))))
    n_chars = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, their token ids and their places in sequences of 1024."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: A trained classifier, hashes and a tokenizer: SQL cannot express run()'s rows. tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if 0 < k < len(STAGES) - 1:  # the first has written its own
            docs = stored(docs, name)
    return docs
