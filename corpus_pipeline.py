"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage works on all that the one before kept, and is written as Parquet
and read again.  ``run`` does that in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nounspan.llm import exact_dedup, jaccard, langid, mixing, packing
from nounspan.llm.common import table
from nounspan.llm.queries import default_vocabulary
from nounspan.session import write_out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles recognise; those without a letter go."""
    profiles = langid.fit_profiles(docs.filter(~langid.held_out("doc_id")))
    return langid.identified(docs, profiles)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts."""
    return jaccard.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_texts(docs, default_vocabulary())


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", packed),
]

# SQL can express neither the language profiles nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
