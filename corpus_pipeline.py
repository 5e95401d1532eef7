"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumigate.llm.base import stored, table
from lumigate.llm.binary_output import materialised
from lumigate.llm.decontaminate import judged as contaminated
from lumigate.llm.mixing import chosen
from lumigate.llm.ngram_join import Join, one_of_each
from lumigate.llm.toxicity import judged as toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxic(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return one_of_each(docs, Join(5, 80))


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return contaminated(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens that are left, mixed to the target weights; each document at most once."""
    return chosen(docs, epochs=1).select("row.*")


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token records in training order."""
    return materialised(docs)


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", untested),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", records),
]

#: Classifier, components, seeds and tokenizer can't be put in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
