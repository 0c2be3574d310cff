"""The queries of the numbered operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from evidary.llm import ctw, fixity, hnsw, langid, manifest, mixing, packing, pagecrf, quality, rabitq, simhash, toxicity, variants
from evidary.llm.common import held_out, read


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged records of a replica of all pages' archive, located by comparing Merkle trees."""
    return fixity.audit_pages(read(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: fingerprints that differ in at most three bits."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under the byte model, and under word counts, of the documents not held out."""
    return ctw.score_all(read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality as its nearest labelled neighbours vote, learned from labels that are not held out."""
    out = held_out(F.col("doc_id"), 4, 2)
    labels = read(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    found = quality.scores(read(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label: cosine of at least 0.93."""
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for each document so that the domains' expected tokens are in proportion to their targets."""
    found = mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    p = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return found.select("doc_id", "tokens", *p, "rate", "copies")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from the languages of those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    found = langid.predictions(docs, F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 2,048, similar documents next to each other."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return rabitq.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probability of being toxic, learned from the labels of those that are not held out."""
    out = held_out(F.col("doc_id"), 4, 2)
    labels = read(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.scores(read(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, misspellings led to the frequent word that is one letter away."""
    return variants.variants(read(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's proof in the Merkle manifest of all documents, and whether what is offered for it verifies."""
    return manifest.audit(read(spark, sf_dir, "documents"))


def op13_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pagecrf.extract(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fixity": op1_fixity,
    "op2_simhash": op2_simhash,
    "op3_ctw": op3_ctw,
    "op4_quality": op4_quality,
    "op5_embeddings": op5_embeddings,
    "op6_mixing": op6_mixing,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_neighbours": op9_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_variants": op11_variants,
    "op12_manifest": op12_manifest,
    "op13_maintext": op13_maintext,
}
ORACLES: dict[str, str] = {"op1_fixity": fixity.SQL.strip(), "op11_variants": variants.SQL.strip(), "op12_manifest": manifest.SQL.strip()}
