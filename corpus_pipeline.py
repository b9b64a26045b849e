"""A training corpus from raw documents: five stages, each one of the operators in tripledger.llm.

Every stage works on all that the one before it kept, written as Parquet and read again. All but the last return
the columns of documents. Any stage takes an empty table, null and empty texts, null and repeated identifiers, and columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripledger.llm import bpe, common, exact_dedup, mixing, ngram_join, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.5 or more go. A null text scores as an empty one; repeated rows score alike."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays; of rows that repeat it, one. Null and empty texts are equal."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity 0.8 or more stays. Texts without words are in no class and stay."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2, repeating; a document appears as often as the mix takes it, which is never where it has no words."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every appearance, with digests of the ids and of what they decode to. A null text has none."""
    return bpe.bpe(docs, outputs=("ids",))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL cannot express the trained model of the first stage; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, for documents put through all stages; each stage's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
