"""A corpus pipeline of five of the operators: each stage takes what the one before it kept.

Language identification drops the documents it rejects; of each group of near copies the first
document stays; passages that occur earlier are cut out; sources are mixed to their target weights; what is
left is packed into sequences.  All stages but the last return the columns of ``documents``.

Defined cases: a null, empty or blank text has no language and goes in the first stage; other columns may be null, and
there may be more of them, of any name: all but the last stage pass them through.  Rows with equal texts are copies, and
the one with the least id stays (null last); rows with one id and different texts are different documents.  An empty
table, or one without labelled rows, gives no rows.  Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resultfeed.llm import jaccard, language, mixing, packing, repeats
from resultfeed.llm.common import read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("pack", pack)]

#: The stages hold a trained model, a sort and a tokenizer: no SQL gives their rows.  Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; between two of them the documents are a Parquet table."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
