"""One query for each operator, over the whole of its table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import bpe, embeddings, fingerprints, html_extract, langid, licenses, line_dedup, minhash, mixing, secrets


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among ``documents``."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("key")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents``, and whether decoding gives each text again."""
    return bpe.encode(read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed credentials in ``documents`` and how widely each is held; a source is an owner and its repository."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of ``pages``."""
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that stand on ten sites or more."""
    return line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, and spans by language, of ``documents``."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of ``documents`` with equal chunks, and which of them hold four fifths of another."""
    return fingerprints.links(read(spark, sf_dir, "documents"), fingerprints.FINE)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence tags and notices in ``documents``."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among ``embeddings``."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ``documents`` in output shards, sources weighted by their tokens to the power 0.7."""
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_secrets": op3_secrets,
    "op4_html": op4_html,
    "op5_line_dedup": op5_line_dedup,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_licenses": op8_licenses,
    "op9_embeddings": op9_embeddings,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {"op3_secrets": secrets.ORACLE, "op5_line_dedup": line_dedup.ORACLE}
