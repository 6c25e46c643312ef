"""The corpus pipeline: each stage is one operator, and reads what the stage before it wrote.

1. language ID: documents in no language go, the others get the predicted one as `lang`;
2. SimHash near-duplicates: one document of each group stays;
3. mixing to target weights: each document stays as often as its rate says (toxic ones not at all);
4. best-fit packing of the token ids into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyframe.llm.common import new_dir
from skyframe.llm.language import in_a_language
from skyframe.llm.mixing import mixed
from skyframe.llm.packing import pack_documents
from skyframe.llm.queries import TARGETS, byte_bpe, domain_labels
from skyframe.llm.simhash import deduplicated


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; null, empty and letterless ones go, rows that repeat stay, other columns are kept."""
    return in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group, once; empty and null texts are one group; rows without a doc_id all stay."""
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says, on average; rows that repeat do so on top of it; without labels all stay once."""
    return mixed(docs, domain_labels(spark, sf_dir), TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset: every row of the mixture is packed, a null or empty text as its end id."""
    return pack_documents(docs, byte_bpe(), end_id=0, capacity=2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None  # SQL expresses neither learning nor tokenizing; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := new_dir(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
