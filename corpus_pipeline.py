"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Quality rules drop documents, line dedup rewrites texts, SimHash keeps one document of each group of near-duplicates
(five-word shingles, similarity 0.8 or more), mixing lays the documents out in the order of the sources' Pfair
schedule, and packing returns the pieces of sequences, which follow that order run by run. No SQL states the fingerprints
or the linear program, so ORACLE_SQL is None and the tests hold `run` against a brute-force version.

Null and empty texts fail the quality rules and go. A null source is a source of its own. Documents of a null doc_id are
kept by every stage that keeps their text; rows that repeat a doc_id and its text come out once, others under one id go or
stay together. Very long texts are read whole by every stage. Extra columns, whatever their names, pass up to packing.
Empty tables give no rows; without trusted labels the base rules of the quality stage decide alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import line_dedup, mixing, packing, quality, simhash
from rasterloom.llm.common import shared_folder, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_in_order(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder, which the next one reads.

    A table that the next stage has been made of is deleted; the last one stays for the caller to read.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
