"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it as the next one's docs.

Defined results, for all stages: other columns than those of documents are dropped;
texts of any length are read whole; an empty table gives an empty table.  What a
stage makes of nulls, repeated rows and ties is in its own docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import stored
from lamina.llm.mixing import mix_sources
from lamina.llm.neardup import near_duplicates
from lamina.llm.packing import pack_documents
from lamina.llm.quality import keep_good
from lamina.llm.secrets import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is judged as an empty one; a null id keeps no document from being
    judged; repeated rows go or stay together; a score at the threshold itself stays.
    """
    return keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in four of five shingles of five words, the least id stays.

    Rows without an id are in no group and stay; a row that repeats another's id
    and text goes, one with another text stays if its id does.  Null texts are alike
    nothing, so they stay.
    """
    docs = docs.select(COLUMNS)
    gone = near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return named.select(COLUMNS).unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts that hold them; every document stays.

    A null text stays null, a null count of characters too; repeated rows are changed
    alike; where spans overlap, one mark stands for them all.
    """
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    clean = redact_secrets(docs.select(COLUMNS), vocabulary, public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source to the share of its count's square root, about as many rows as before.

    A null source is a source of its own; rows that share an id, null or not, draw each
    for itself; a row drawn twice comes twice; equal order keys are in any order.
    """
    return mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    A null text is empty, so it is its end id alone; a null id stays null; repeated rows
    are packed each; pieces of one length are dealt to their places in any order.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The classifier's and the tokenizer's results are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
