"""Exact deduplication by a heavy-hitter split.

Misra-Gries summaries name the digests that may be frequent, exact counts verify them, and the winners (fewer than
``counters`` rows by construction) are broadcast, so their rows never meet in one task. All other digests occur in at
most 2 / counters of the rows and use an ordinary shuffle.

Defined results: a null text counts as empty; rows with a null id stay in their group but never win it while another
row has an id; rows that repeat an id within a group share its decision in ``mark`` and one of them survives in
``keep``, null ids counting as one id; an empty table gives an empty table; extra columns, whatever their names, pass
through ``keep`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.common import column, cut, fresh_name

#: Counters of a Misra-Gries summary: digests in more than 2 / COUNTERS of all rows are surely found.
COUNTERS = 1024


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for key, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
                held[key] = held.get(key, 0) + n
            if len(held) > counters:  # subtract the (counters + 1)-th largest count from all
                floor = sorted(held.values(), reverse=True)[counters]
                held = {k: v - floor for k, v in held.items() if v > floor}
        if held:
            yield pa.RecordBatch.from_pydict({"digest": list(held), "n": list(held.values())}, schema=pa.schema([("digest", pa.string()), ("n", pa.int64())]))

    return run


def _digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(column(text_col), F.lit("")).cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(column(id_col).alias("id"), _digest(text_col).alias("digest"))


def heavy_digests(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified heavy digests with their exact size and largest id: fewer than ``counters`` rows.

    Each summary undercounts a digest by at most its rows / (counters + 1), so a digest in more than 2n / counters rows
    keeps over n / counters in the summed summaries, and fewer than ``counters`` digests can.
    """
    n = table.count()
    candidates = (
        table.select("digest").mapInArrow(_summaries(counters), "digest string, n bigint")
        .groupBy("digest").agg(F.sum("n").alias("low")).where(F.col("low") > F.lit(n / counters)).select("digest")
    )
    return table.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = cut(digests(docs, id_col, text_col))
    heavy = cut(heavy_digests(table, counters))
    often = table.join(F.broadcast(heavy), "digest")
    rest = table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
    both = often.unionByName(rest.join(groups, "digest"))
    return both.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row of each group of equal texts, all columns: heavy losers go map-side, the rest meet in one shuffle."""
    table = cut(digests(docs, id_col, text_col))
    sha, often, best, place = (fresh_name(k) for k in ("sha", "often", "best", "place"))
    heavy = cut(heavy_digests(table, counters)).select(F.col("digest").alias(often), F.col("keep_id").alias(best))
    marked = docs.withColumn(sha, _digest(text_col)).join(F.broadcast(heavy), F.col(sha) == F.col(often), "left")
    light = marked.where(F.col(often).isNull() | column(id_col).eqNullSafe(F.col(best)))
    first = Window.partitionBy(sha).orderBy(column(id_col).desc_nulls_last())
    return light.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(sha, often, best, place)
