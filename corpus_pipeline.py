"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, is written as Parquet in the shared folder and read again. The
first four return the columns of documents. Null texts, empty texts, empty tables, repeated rows and extra
columns are handled as the operators define it; extra columns do not pass.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, language, packing, quality, suffixes
from gridloom.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that is likelier than all others together, go."""
    judged = language.identify(docs.select(*COLUMNS), language.fit(docs))
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once."""
    groups = jaccard.jaccard_components(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(first, "doc_id").dropDuplicates(["doc_id"]).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a document that consists of nothing else goes."""
    made = suffixes.without_repeats(docs.select(*COLUMNS), decoded=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return (
        made.where("n_removed = 0 OR n_removed < n_bytes")
        .withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("packing", pack_sequences),
]

#: Trained models, tokenizers and packing are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
