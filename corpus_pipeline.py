"""The corpus pipeline: language identification, near-duplicate removal, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of docs, whatever they are. Very long texts are read whole, and empty tables
pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext import reachable
from loomtext.llm import langid, mixing, packing, simhash
from loomtext.llm.common import staged

#: SQL can express neither the language model nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. Those go whose text is null or has no letter, or whose best language has a
    posterior under a half."""
    reachable(spark)
    model, rare = langid.train(docs.filter(~langid.split_fold(F.col("doc_id"))))
    if not model.langs:  # nothing to learn from: only texts without a letter can be told apart
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.known_language(docs, model, rare)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. The smallest id stays, a null id
    only if there is no other, and one of equal rows; texts that are not alike all stay, whatever their ids."""
    reachable(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for 90 % of the tokens by the target weights, each at most once. A null language or source is the empty
    name, a null text costs one token, and rows that tie in id and text are taken together."""
    domain = mixing.domain_of(F.col("source"))
    return mixing.mix(docs, domain, percent=90, max_epochs=1).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null text is empty and has the end token alone; rows with
    equal or null ids are packed each on its own."""
    reachable(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
