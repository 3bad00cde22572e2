"""The corpus pipeline: toxicity, SimHash near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it again as the next stage's ``docs``.  Stages keep all columns of the documents,
whatever their names, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litsieve.llm import packing, simhash, suffix_dedup, toxicity
from litsieve.llm.common import park, tables_of

#: Bytes of a repeated string in this pipeline: passages of 51 words and more are 250 bytes long or longer.
REPEATED_BYTES, ANCHOR_WIDTH = 200, 128


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones outside the held-out rows, does not reject.

    Null and empty texts are judged as empty ones; rows that repeat go or stay together.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that shares 0.8 of its five-word shingles.

    Null texts and texts without words are alike, so one of them stays; rows equal in doc_id and text count once;
    rows with a null doc_id stay.
    """
    return simhash.keep_first(docs, simhash.similar_groups(docs))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings of ``REPEATED_BYTES`` bytes that start more than once.

    No row goes: null texts stay null, and texts that repeat as a whole become empty if they are so long.
    """
    return suffix_dedup.remove_repeats(docs, REPEATED_BYTES, ANCHOR_WIDTH)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences; null and empty texts are one token each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", remove_repeats),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage has parked goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with tables_of() as made:
            result = park(stage(spark, docs, sf_dir), f"stage-{name}")
        made.drop(but=result)
        if before is not None:
            before.drop()
        docs, before = result.df, result
    return docs
