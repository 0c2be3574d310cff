"""The corpus pipeline: five stages over ``documents``, each one of the text operators.

Each stage takes all rows that the one before kept, and its decisions take effect on them; rows are
written as Parquet between the stages.  Columns that the input has besides the named ones are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidary.llm import langid, mixing, packing, simhash, toxicity
from evidary.llm.common import free_name, held_out, read, stored

#: A text whose best two languages are closer than this in probability is rejected.
LANGUAGE_MARGIN = 0.05
#: A text of at least this probability of being toxic is rejected.
TOXIC = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter and those between two languages go."""
    learn = F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)
    name = free_name(docs, "language")
    named = langid.identify(docs, langid.fit(docs, learn), name, LANGUAGE_MARGIN)
    found = F.col(name)
    return named.where((found["lang_pred"] != "und") & ~found["ambiguous"]).drop(name)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id"), 4, 2))
    name = free_name(docs, "toxic_score")
    return toxicity.score(docs, toxicity.fit(docs, labels), name).where(F.col(name) < TOXIC).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned and repeated so that the domains' expected tokens are in proportion to their targets."""
    return mixing.mixed(docs, read(spark, sf_dir, "labels"), repeat=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, similar documents next to each other."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Fitted classifiers and a tokenizer are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
