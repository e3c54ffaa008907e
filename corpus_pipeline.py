"""Cleaning and packing of the documents table in four stages.

Each stage gets all rows that the one before it kept, written as Parquet and read again.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.filters import without_ids
from tidemark.llm.language import UNKNOWN, fit, predict
from tidemark.llm.ngram_join import join
from tidemark.llm.packing import pack
from tidemark.llm.store import keep, unique_ids
from tidemark.llm.substrings import clean_texts

#: A text whose language is less sure than this is in none of the known ones.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a known language; a text without letters, or of no language, goes.

    The model learns from the labelled rows.  A row without a doc_id stays or goes by its text, and so does each row
    that repeats another.  Of languages of equal sums the first by name counts.  Texts are read whole, however
    long.  A table without labelled rows gives a model without languages, and no row stays; an empty one stays empty.
    """
    found = predict(docs, fit(docs), whole_rows=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id; of rows that repeat a doc_id the one with the least text."""
    docs = unique_ids(docs, "doc_id", "text")
    return without_ids(docs, "doc_id", keep(join(docs).filter("component < id").select("id")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 or more words that an earlier document holds.

    A text that loses nothing stays as it is; one that loses every word goes; n_chars is counted anew.
    """
    out = clean_texts(unique_ids(docs, "doc_id", "text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences, as the packing operator's query returns them.

    Every row is a document: repeats, rows without a doc_id and null texts (the end token alone) too.  A long text is
    cut into pieces and loses nothing.  An empty table gives no pieces; columns other than doc_id and text don't count.
    """
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", known_language), ("ngram_join", one_of_each_group), ("substring_dedup", without_repeats), ("packing", packed)]

#: Models, similarity groups and token ids can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
