"""The corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
others there are and however they are called. A stage works on all rows that its predecessor kept, which run() writes as
Parquet in the shared folder and reads again. An empty table passes all stages as one; rows of null or repeated doc_ids
are rows of their own; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, mixing, simhash, suffix_dedup, toxicity
from helixframe.llm.common import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (7) rejects go. Null and empty texts have no hits and stay; equal texts share
    their fate. Without labels nothing is rejected."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (9) stays, that with the smallest doc_id, nulls last; of equal ids that with the
    least hash of its text. Documents without words form one group."""
    return simhash.keep_one_per_component(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that occur before (6) are cut out of the texts; what is left of a broken character goes too. Null
    texts stay null, and texts without repeats as they are."""
    return suffix_dedup.without_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages (10) are cut out of the texts. Null texts stay null, and texts without hits as they are; an empty
    benchmark cuts nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture (8) takes. Null texts have size 0; a null source is a source."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", cut_benchmark),
    ("source_mixing", mix),
]

#: Learned scores and cuts through texts are beyond SQL; the tests run the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
