"""Training-data pipeline over ``documents``: every stage works on all its predecessor kept.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, columns of any name besides its
own input's, and an empty table (which gives an empty one). All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup as exact
from corpusloom.llm import packing, simhash, suffixes, toxicity
from corpusloom.llm.common import documents, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject.

    A null or empty text has no word and stays; so does everything where the labels are not of both kinds. Repeated rows share their fate.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat it, one.

    A null text equals an empty one. A null id loses against any other.
    """
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles the one with the smallest id.

    Texts without words (null, empty, blank) are near copies of each other. Rows without an id stay; rows that repeat one all stay or go.
    """
    return simhash.drop_near(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that documents with smaller ids have too, by whole characters.

    A null text stays null, one that loses all is empty. A null id is larger than any other; rows that repeat an id lose nothing to each other.
    """
    return suffixes.drop_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids, as the pieces of documents they hold.

    A null or empty text is the end id alone. Rows that repeat an id are documents of their own.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("passage_dedup", drop_passages), ("packing", pack)]

#: SQL cannot express the model and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; what each stage returns is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
