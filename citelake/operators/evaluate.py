"""Retrieval metrics and multiset equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(group: str, *order: Column):
    return Window.partitionBy(group).orderBy(*order)


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query, recall, hit, reciprocal_rank, ndcg) for ranked (query, item, rank) and relevant (query, item).

    A query of ``queries`` (else of either table) without relevant items has recall and nDCG 1 and no hit.
    """
    asked = queries if queries is not None else ranked.select("query").unionByName(relevant.select("query"))
    top = F.col("rank") <= k
    made = relevant.join(ranked, ["query", "item"], "left").groupBy("query").agg(
        F.count("*").alias("n"), F.count(F.when(top, 1)).alias("found"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("gain"),
    )
    made = asked.select("query").distinct().join(made, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("n").isNotNull()
    return made.select(
        "query", F.when(some, F.col("found") / F.col("n")).otherwise(1.0).alias("recall"), F.when(some, F.col("found") > 0).otherwise(False).cast("int").alias("hit"),
        F.coalesce("reciprocal_rank", F.lit(0.0)).alias("reciprocal_rank"), F.when(some, F.col("gain") / ideal).otherwise(1.0).alias("ndcg"),
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, whatever the order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
