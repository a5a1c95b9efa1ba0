"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, then exact and near copies, then personal data is replaced,
and what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.base import fold, read, shared_path
from folioframe.llm.exact import drop_exact
from folioframe.llm.neardup import Similarity, drop_near
from folioframe.llm.packing import pack_documents
from folioframe.llm.pii import pseudonymised
from folioframe.llm.queries import PHRASE
from folioframe.llm.toxicity import drop_toxic, train
from folioframe.llm.vocabularies import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger trained on ``labels`` scores as toxic go."""
    return drop_toxic(docs, train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles the one with the smallest id stays."""
    return drop_near(docs, Similarity(words=5, num=80, den=100))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms of the same format."""
    return pseudonymised(docs, PHRASE, chars_col="n_chars" if "n_chars" in docs.columns else None).drop("pii_spans")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: A trained tagger, similarity links, a keyed cipher and best fit have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
