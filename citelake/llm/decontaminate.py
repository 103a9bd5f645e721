"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has almost no Jaccard similarity with it, so the sketch is kept on the item's side:
under each of H hash functions an item keeps its smallest shingle, and the share of these that a document holds
estimates without bias how much of the item the document contains. Items are partitioned by their number of shingles;
each partition has its own H and asks for as many hits as an item with the threshold's containment misses with a chance
under MISS. Candidates are verified on the full shingle sets of item and document.

Items go to the executors in blocks of bounded size; each block meets all documents in one narrow pass.

Defined results: words, lower-casing and shingles as in ``common`` (five words; a shorter text is one shingle). Null or
empty items and documents match nothing. Repeated items match each on its own; repeated documents likewise; ids may be
null and of any type. Empty tables give empty tables. ``keep`` passes rows and columns through unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citelake.llm.common import bounded_batches, chunks, column, mapped, mix, shingles, text_buffer, tidy

THRESHOLD = 0.75
#: Chance of missing an item at the threshold's containment.
MISS = 1e-9
#: Text bytes of the items in a block, the proven bound of what a task is sent.
BLOCK_BYTES = 8 << 20
_U = np.uint64


def functions_for(n_shingles: int) -> int:
    """Hash functions of the partition that an item of this many shingles belongs to."""
    return 16 if n_shingles < 128 else 32 if n_shingles < 1024 else 64


def hits_needed(functions: int, threshold: float, miss: float = MISS) -> int:
    """The most hits h with P(Binomial(functions, threshold) < h) <= miss."""
    below, h = 0.0, 0
    while h < functions:
        below += math.comb(functions, h) * threshold**h * (1 - threshold) ** (functions - h)
        if below > miss:
            break
        h += 1
    return max(h, 1)


class ItemIndex:
    """The sketches of one block of items and their full sets."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float):
        self.threshold = threshold
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        sets, at = shingles(data, offsets)
        self.ids, self.sets, self.at = ids, sets, at
        anchors, owners, weights = [], [], []
        self.need = np.ones(len(ids), np.int64)
        for k in range(len(ids)):
            own = sets[at[k] : at[k + 1]]
            if not len(own):
                continue
            h = functions_for(len(own))
            self.need[k] = hits_needed(h, threshold)
            lowest = [own[np.argmin(mix(own ^ mix(np.array([f + 1], np.uint64))))] for f in range(h)]
            values, counts = np.unique(np.array(lowest, np.uint64), return_counts=True)
            anchors.append(values)
            owners.append(np.full(len(values), k))
            weights.append(counts)
        order = np.argsort(flat := np.concatenate(anchors) if anchors else np.zeros(0, np.uint64), kind="stable")
        self.owner = np.concatenate(owners)[order] if anchors else np.zeros(0, np.int64)
        self.weight = np.concatenate(weights)[order] if anchors else np.zeros(0, np.int64)
        self.anchor, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, item's shingles, shared shingles) of every pair that reaches the threshold."""
        if not len(self.anchor):
            return []
        sets, at = shingles(data, offsets)
        where = np.minimum(np.searchsorted(self.anchor, sets), len(self.anchor) - 1)
        hit = np.flatnonzero(self.anchor[where] == sets)
        if not len(hit):
            return []
        slot = where[hit]
        size = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(size) + size, size) + np.arange(size.sum())
        text = np.repeat(np.searchsorted(at, hit, side="right") - 1, size)
        pairs, back = np.unique(text * len(self.ids) + self.owner[entry], return_inverse=True)
        hits = np.bincount(back, weights=self.weight[entry])
        out = []
        for p, n in zip(pairs.tolist(), hits.tolist(), strict=True):
            t, k = divmod(p, len(self.ids))
            if n < self.need[k]:
                continue
            own, held = self.sets[self.at[k] : self.at[k + 1]], sets[at[t] : at[t + 1]]
            shared = int(np.count_nonzero(held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own))
            if shared >= self.threshold * len(own):
                out.append((t, k, len(own), shared))
        return out


def item_blocks(items: DataFrame, id_col: Column, text_col: str, threshold: float, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """The items in blocks of about block_bytes of text; more items make more blocks, not larger ones."""
    rows = items.select(id_col, column(text_col).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)).collect()
        yield ItemIndex([r["id"] for r in part], [r["text"] for r in part], threshold)


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, n_shingles, n_shared, containment."""
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())])
    kind = to_arrow_type(items.schema[item_id].dataType)
    found = None
    for index in item_blocks(items, column(item_id).alias("id"), item_text, threshold, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffer(batch.column(1))
                for i, j in chunks(offsets):
                    hits = index.search(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if hits:
                        ids = batch.column(0).take(pa.array([i + t for t, *_ in hits]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[k] for _, k, _, _ in hits], kind), pa.array([n for _, _, n, _ in hits], pa.int64()), pa.array([s for *_, s in hits], pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        part = bounded_batches(rows).mapInArrow(tidy(run), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def keep(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item; narrow."""
    k = docs.columns.index(text_col)
    for index in item_blocks(items, F.lit(0).alias("id"), item_text, threshold, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                data, offsets = text_buffer(batch.column(k))
                for i, j in chunks(offsets):
                    for t, *_ in index.search(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        clean[i + t] = False
                yield batch.filter(pa.array(clean))

        docs = mapped(docs, run, [])
    return docs
