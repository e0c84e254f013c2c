"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes the documents its predecessor kept, as reread from Parquet, and its decisions take
effect: rejected, duplicate and contaminated documents go, secrets are replaced in the text, and the
last stage leaves out toxic documents and gives every other one, with all its columns, its rate in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonarium.llm.decontaminate import decontaminated
from zonarium.llm.mixing import Mix, mix_sources
from zonarium.llm.near_copies import one_of_each
from zonarium.llm.quality_rules import kept_rows
from zonarium.llm.secret_scan import redact
from zonarium.llm.simhash_dedup import written


#: Toxic documents go first; the rates are fitted for those that stay.
MIX = Mix(weights={"clean": 0.94, "low": 0.05, "toxic": 0.01}, leave_out={"toxic": 0.5})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail (fewer than 20 words); rows are judged one by one, so repeated rows and ids share a
    verdict; an empty table stays empty; every column passes, whatever its name.
    """
    return kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash fingerprints and by verified MinHash bands, the one with the smallest id.

    Null and empty texts are one group; rows with one id and different texts are judged apart, of equal rows one
    stays; rows without an id stay; an empty table stays empty; every column passes.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts and items match nothing; repeated rows and items change nothing; null ids are judged like
    others; an empty table or benchmark leaves all documents; every column passes.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets replaced in the text, and ``n_chars`` kept true.

    Null and empty texts stay as they are; rows are scanned one by one; an empty table stays empty; every other
    column passes.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not judged toxic, with all their columns and their rates in the mix.

    Null and empty texts have the prior as posterior and a rate like others; labels without a document, twice or
    with nulls are used as far as they match; without labels the posterior is uniform and nothing is left out; an
    empty table stays empty; a column named like one of the added ones gives way to it.
    """
    return mix_sources(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX, keep=tuple(docs.columns))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing", mixing),
]

#: The near-duplicate fingerprints, the network and the fitted rates are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
