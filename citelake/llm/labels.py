"""Labelled rows for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary"))) % folds


def one_per_id(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id and label (0 or 1) of the rows that have both; of labels that disagree the larger counts."""
    rows = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id IS NOT NULL AND label IN (0, 1)")
    return rows.groupBy("label_id").agg(F.max("label").alias("label"))
