"""From documents to token ids: language ID, line dedup, near-duplicate removal, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
works on all rows that the stage before it kept. ``run`` writes what a stage returns to the shared folder and hands the
table on, so that no stage is computed twice and a lost executor costs its own tasks only; tables that a stage made on its
way, and the one it read, go once it has ended. Columns beyond those of documents are carried along or set to null, whatever
their names; an empty table passes all stages as an empty table; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import bpe, langid, line_dedup, minhash, mixing
from knotwork.operators.lineage import cut, release, written  # noqa: F401


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID accepts; the others go.

    Null and empty texts, and those without letters, are accepted by no language and go. Rows with a null lang are judged
    like others and train nothing. Repeated rows are judged each, alike; ties between languages decide no acceptance.
    """
    return langid.keep_known(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of ten sites or more; one that loses all its text goes, as others hold each of its lines.

    Null and empty texts lose nothing and stay. Of rows that tie for the least doc_id the one of least key keeps a line, null
    ids come last; rows equal in id and text keep or lose alike. A null source is no site.
    """
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.where("removed_lines = 0 or trim(text) <> ''").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id, and all that are in no group.

    Null and empty texts, and those without words, are in no group and stay, each of them. Of rows that tie for the least
    doc_id the one of least key stays, null ids come last; of rows equal in id and text one stays.
    """
    return minhash.drop_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each slot: a block of the source drawn for it, with the doc_id and lang of the document it begins in.

    Null and empty texts have no tokens and are in no block. A null source is the source ''. Repeated rows are packed as
    often as they occur; rows that tie in the order of packing are laid in order of doc_id and text. Without tokens there is
    no row.
    """
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with its lang and source: a null text has null ids, an empty one none; repeated rows are
    encoded each."""
    return bpe.encode(docs, more=("lang", "source"))


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]
#: SQL has no language model, minima or merges: the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
