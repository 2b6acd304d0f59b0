"""Training-corpus pipeline: quality, near-duplicates, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All stages but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects go; labels come from the ``labels`` table.
2. near_duplicates: SimHash of five-word shingles, similarity of 0.8 or more verified on the shingle sets; the smallest doc_id of a group stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. mixing: rows stand in the order of the Pfair schedule, which the files keep.
5. token_files: ids of the rows in that order, written and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, mixing, quality, simhash, token_files
from skein.plans.durable import durable


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in the order of the stored rows; a table that isn't read from files goes by doc_id."""
    settings = token_files.TokenFiles(public_tokenizers.path("byte_bpe_50k.json"))
    stored = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*stored)
    except AnalysisException:
        stored = None
    return token_files.read_tokens(token_files.write_tokens(docs, settings, stored))


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: The classifier's and the tokenizer's results are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
