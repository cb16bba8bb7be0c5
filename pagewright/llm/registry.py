"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import audio, conversations, embeddings, minhash, mixing, packing, quality, secrets, simhash, spelling, substrings, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and alignments of all documents heard as recordings.

    The tables hold no recordings, so the UTF-8 bytes of each text are its samples. A code looks at 608 of them and a match
    of different recordings needs 960; shorter texts are linked to exact copies. Copies of a text are copies of a recording.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("audio"))
    return audio.align(docs, "doc_id", "audio", audio.Sound(rate=11025, frame=128, hop=32))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a repeated 100-byte string covers."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest rule for the url of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, with those that ownership counts add."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged first."""
    return conversations.report(_table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent words that they are variants of."""
    return spelling.group(_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return minhash.compare_neighbours(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_mixing": op2_mixing,
    "op3_audio": op3_audio,
    "op4_substrings": op4_substrings,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_conversations": op11_conversations,
    "op12_spelling": op12_spelling,
    "op13_fingerprints": op13_fingerprints,
}
ORACLE_SQL: dict[str, str] = {"op7_url_filter": urls.ORACLE, "op11_conversations": conversations.ORACLE, "op12_spelling": spelling.ORACLE}
