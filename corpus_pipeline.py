"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir) and gets all that the stage before it kept.

All stages: a null text counts as empty; rows with a null id stay documents of their own; an empty table gives an empty
table; columns beside doc_id and text pass through whatever their names, up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citelake.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from citelake.llm.common import ensure_checkpoint_dir
from citelake.llm.queries import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; it learns from the labels of the documents at hand.

    Repeated rows are judged alike; without labels of both classes all documents stay, or go if all labels are toxic.
    """
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, and of rows that share it too one."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the one with the smallest doc_id stays; texts without words always do."""
    return near_dedup.keep(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, however often they are repeated; without items all stay."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and the text that they decode to; an empty text has no tokens."""
    path = tokenizer_path(TOKENIZER)
    return bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded").drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: SQL can express neither the toxicity model nor the tokens; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    What a stage wrote goes when the next one has written; the last folder holds the rows that are returned.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            _remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
