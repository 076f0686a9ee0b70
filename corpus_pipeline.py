"""A training corpus in stages: each gets documents and gives those the next one works on.

Every stage but the last returns the columns of the documents it gets. Rows without doc_id are never
dropped as copies; null texts count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import mixing, pieces, quality, simhash, substrings
from terrane.llm.queries import piece_model
from terrane.llm.shared import tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score 0.5 or more, by a discriminant of all labelled ones."""
    return quality.accepted(spark, docs, tables(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of five-word shingles the one of smallest doc_id, once."""
    return simhash.one_of_each(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeats: words left are joined by one space where any went, n_chars follows; a document that loses all its words goes."""
    found = substrings.deduplicated(spark, docs)
    cut = found.filter("n_removed < n_words or n_words = 0").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken."""
    return mixing.mixed_documents(spark, docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids joined by commas, and the text that they decode to."""
    return pieces.encode_documents(docs, piece_model(), ["doc_id", "source"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = tables(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
