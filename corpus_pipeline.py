"""Training data out of raw documents: rejected, repeated and near-repeated texts go, sources are mixed, the rest is packed.

Every stage takes all rows that the one before it kept, written as Parquet in between. Stages return the columns of their input,
but for the last, which returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import exact_dedup, mixing, packing, quality, simhash
from trialframe.llm.queries import byte_bpe, remainder, table
from trialframe.session import cut

#: documents that score below this go
LEAST_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least LEAST_QUALITY; labels of ids with remainder 0 by 5 are never learned from.

    The classifier is fitted on at most ``quality.SAMPLE_ROWS`` labelled rows.
    """
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), held_out=held_out), LEAST_QUALITY)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after joining white space, the one with the smallest id."""
    return exact_dedup.drop_repeats(docs)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the one with the smallest id."""
    return simhash.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix: sources weigh 3, 1, 2 in turn and share 150 % of all words, none more than twice its own."""
    return mixing.mixed_documents(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", different_documents),
    ("mixing to target weights", mixed_documents),
    ("harmonic packing", packed_documents),
]

#: the classifier and the fingerprints have no SQL; the tests hold every stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
