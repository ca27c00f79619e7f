"""A training-corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.common import Workspace
from sitequarry.llm.decontaminate import decontaminate
from sitequarry.llm.language_id import keep_identified
from sitequarry.llm.mixing import mixed
from sitequarry.llm.ngram_join import drop_near_duplicates
from sitequarry.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language cannot be identified go: null, empty and letterless texts, and those that share too few
    n-grams with the labelled texts. The others stay row by row, repeated ones too."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each connected group of the n-gram Jaccard join one document stays, that of the least doc_id (null last); of equal
    rows one, of texts without a token all."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: passages of the benchmark go, and documents that are at least half such. Null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as many times as its source's target weight asks for; a null source is a source. Rows of one doc_id
    get equally many copies."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: row_number, shard and slot are added, in order of doc_id (null first, ties by a hash of the row)."""
    return shard(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("feistel_sharding", sharding),
]

#: Language identification and the LSH forest have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Texts of any length, null columns, repeated rows and further columns are as each stage says; an empty
    table gives no rows."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            ws.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
