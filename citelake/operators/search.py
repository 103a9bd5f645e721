"""Keyword, vector and fused search."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.operators.algorithms import checkpointed

#: Words whose slots a task keeps at once.
WORDS_KEPT = 1 << 18

K1, B, RRF_K = 1.2, 0.75, 60


def parse_query(text: str) -> list[tuple[str, bool]] | None:
    """Terms and whether each is a prefix (the last); null under two characters. Operator words do not count."""
    words = [w for w in re.split(r"\s+", text.strip()[:100]) if w and w not in ("AND", "OR", "NOT")]
    if len("".join(words)) < 2:
        return None
    return [(w.lower(), i == len(words) - 1) for i, w in enumerate(words)]


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf, len) per document and term."""
    said = docs.select("id", F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    return said.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str | list[tuple[str, bool]], k: int, text: str = "text", stub: Column | None = None) -> DataFrame:
    """(id, score): documents with all terms, best first; the last term of a text query is a prefix.

    The words of each text are counted once and kept for both the statistics and the hits. The statistics are a job of
    their own: a broadcast that waits for a pass over all texts runs into its time limit. As in an index scan, stubs are left
    out after the k best are taken.
    """
    terms = parse_query(query) if isinstance(query, str) else sorted(set(query))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    said = docs.select("id", *([stub.alias("stub")] if stub is not None else []), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    each = said.select("id", *(["stub"] if stub is not None else []), F.size("w").alias("len"), *_counts(terms)).persist()
    stats = each.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    known = {c: F.lit(v).cast(kind) for (c, kind), v in zip(stats.dtypes, stats.first(), strict=True)}
    hits = each.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).withColumns(known)
    score = F.lit(0.0)
    for i in range(len(terms)):
        score += _weight(F.col(f"tf{i}"), F.col(f"df{i}"))
    best = hits.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)
    return (best if stub is None else best.where(~F.coalesce("stub", F.lit(False)))).select("id", "score")


def _weight(tf: Column, df: Column) -> Column:
    return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))


def bm25_many(docs: DataFrame, queries: DataFrame, k: int, least_share: float = 0.0) -> DataFrame:
    """(query, id, score, matched, asked, rank): the k best documents of each query (query, text) by the terms they share,
    joined through an inverted index. matched of asked distinct terms occur; with less than a share none is ranked."""
    index = tokens(docs).persist()
    stats = index.select("id", "len").distinct().agg(F.avg("len").alias("mean"), F.count("*").alias("n"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    asked = tokens(queries.select(F.col("query").alias("id"), "text")).select(F.col("id").alias("query"), "term")
    size = asked.groupBy("query").agg(F.count("*").alias("asked"))
    hits = index.join(df, "term").join(asked, "term").join(F.broadcast(stats))  # one row
    made = hits.withColumn("score", _weight(F.col("tf"), F.col("df"))).groupBy("query", "id").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
    made = made.join(size, "query").where(F.col("matched") >= least_share * F.col("asked"))
    turn = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "id")
    return made.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def holders(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id): documents that have every term of a query."""
    asked = tokens(queries.select(F.col("query").alias("id"), "text")).select(F.col("id").alias("query"), "term")
    size = asked.groupBy("query").agg(F.count("*").alias("asked"))
    met = tokens(docs).select("id", "term").join(asked, "term").groupBy("query", "id").agg(F.count("*").alias("matched"))
    return met.join(size, "query").where("matched = asked").select("query", "id")


def _counts(terms: list[tuple[str, bool]]) -> list[Column]:
    def count(term: str, prefix: bool) -> Column:
        return F.size(F.filter("w", lambda w: w.startswith(term) if prefix else w == F.lit(term)))

    return [count(*t).alias(f"tf{i}") for i, t in enumerate(terms)]


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length, as that of a text without words."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, query: list[float], k: int, exclude: int | None = None) -> DataFrame:
    """(id, cosine, score = (1 + cosine) / 2) of the k nearest, exact; the top k is taken per partition first.
    A vector without length is near to none."""
    rows = vectors if exclude is None else vectors.where(F.col("id") != exclude)
    near = rows.select("id", cosine(F.col("vector"), F.array(*map(F.lit, map(float, query)))).alias("cosine"))
    return near.where("cosine IS NOT NULL").orderBy(F.desc("cosine"), "id").limit(k).withColumn("score", (1 + F.col("cosine")) / 2)


def entities(kinds: dict[str, DataFrame], query: str, limit: int) -> DataFrame:
    """(kind, id, title, score, papers, place): the best of each kind of (id, text, title, papers), ties to more papers.

    Three times the limit are fetched of each kind before they are ordered, as of an index that ranks by score alone.
    """
    out = None
    for kind, rows in kinds.items():
        hits = bm25(rows, query, 3 * limit).join(rows.select("id", "title", "papers"), "id")
        turn = Window.partitionBy("kind").orderBy(F.round("score", 9).desc(), F.desc("papers"), "id")
        part = hits.withColumn("kind", F.lit(kind)).withColumn("place", F.row_number().over(turn)).where(F.col("place") <= limit)
        part = part.select("kind", F.col("id").cast("string").alias("id"), "title", "score", "papers", "place")
        out = part if out is None else out.unionByName(part)
    return out


class SemanticUnavailable(ValueError):
    """No stored vectors, or of another model than the one asked with."""


def check_model(config: DataFrame | None, model: str, dimensions: int) -> None:
    """config: one row (model, dimensions) or None."""
    row = config.first() if config is not None else None
    if row is None:
        raise SemanticUnavailable("there are no embeddings yet")
    if (row["model"], row["dimensions"]) != (model, dimensions):
        raise SemanticUnavailable(f"embedded with {row['model']} of {row['dimensions']} dimensions, asked with {model} of {dimensions}")


def check_dimensions(n: int) -> int:
    if not 1 <= n <= 4096:
        raise ValueError("vectors have 1 to 4096 dimensions")
    return n


def embedding_text(title: Column, abstract: Column, description: Column) -> Column:
    """Title, empty line, abstract or else description; trimmed, 6000 characters at most."""
    body = F.coalesce(F.nullif(abstract, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))
    return F.substring(F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), body)), 1, 6000)


def hybrid(docs: DataFrame, vectors: DataFrame | None, query: str, config: DataFrame | None = None, model: str = "hashing-256", dimensions: int = 256, pool: int = 50, limit: int = 20, stub: Column | None = None) -> tuple[DataFrame, str | None]:
    """(id, score, matched_by, keyword_rank, semantic_rank) by rank fusion of a pool of each, and a note if the semantic
    half is missing. Queries under two characters find nothing. Each pool is made once, as a table of its own."""
    text = query.strip()
    empty = docs.select("id", F.lit(0.0).alias("score")).limit(0)
    keyword = bm25(docs, text, pool, stub=stub) if len(text) > 1 else empty
    keyword = checkpointed(ranked(keyword.withColumn("score", F.round("score", 9))))
    semantic, note = ranked(empty), None
    if len(text) > 1:
        try:
            if config is not None or vectors is None:
                check_model(config, model, dimensions)
            near = knn(vectors, hash_vector(text, dimensions), pool)
            semantic = checkpointed(ranked(near.select("id", F.round("cosine", 9).alias("score"))))
        except SemanticUnavailable as e:
            note = f"Keyword matches only: {e}"
    both = fuse({"keyword": keyword, "semantic": semantic})
    for name, rows in (("keyword", keyword), ("semantic", semantic)):
        both = both.join(rows.select("id", F.col("rank").alias(f"{name}_rank")), "id", "left")
    return both.orderBy(F.round("score", 12).desc(), "id").limit(limit), note


def centroid(vectors: DataFrame, group: str) -> DataFrame:
    """(group, pos, value): mean of unit vectors, made a unit vector again."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    each = vectors.select(group, norm.alias("norm"), F.posexplode("vector").alias("pos", "v")).where("norm > 0")
    mean = each.groupBy(group, "pos").agg(F.avg(F.col("v").cast("double") / F.col("norm")).alias("m"))
    total = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("t"))
    return mean.join(F.broadcast(total), group).select(group, "pos", (F.col("m") / F.col("t")).alias("value"))


def ranked(hits: DataFrame, score: str = "score") -> DataFrame:
    """Hits of one bounded list with their rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """(id, score, matched_by): reciprocal rank fusion of ranked lists."""
    parts = [df.select("id", "rank", F.lit(name).alias("by")) for name, df in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("by")), ",").alias("matched_by"))


def hash_vector(text: str, dimensions: int = 256) -> list[float]:
    """Signed feature hashing of the words of a text by BLAKE2b, at unit length."""
    out = [0.0] * dimensions
    for word in re.findall("[a-z0-9]+", text.lower()):
        d = hashlib.blake2b(word.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "big") % dimensions] += 1.0 if d[4] & 1 else -1.0
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


class _Slots(dict):
    """The slot of each word, behind all slots if its sign is negative; words are hashed when first met."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        d = hashlib.blake2b(word.encode(), digest_size=8).digest()
        self[word] = at = int.from_bytes(d[:4], "big") % self.dimensions + (0 if d[4] & 1 else self.dimensions)
        return at


def embed(docs: DataFrame, text: str = "text", dimensions: int = 256) -> DataFrame:
    """(id, vector): ``hash_vector`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, find = _Slots(dimensions), re.compile("[a-z0-9]+").findall
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                made = np.zeros((part.num_rows, dimensions))
                for row, t in zip(made, part.column(1), strict=True):
                    if said := find((t.as_py() or "").lower()):
                        n = np.bincount([slots[w] for w in said], minlength=2 * dimensions)
                        row += n[:dimensions] - n[dimensions:]
                size = np.sqrt((made * made).sum(axis=1, keepdims=True))
                made = (made / np.where(size, size, 1)).astype(np.float32)
                at = pa.array(np.arange(part.num_rows + 1) * dimensions, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(made.ravel()))], names=["id", "vector"])

    return docs.select(F.col("id").cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id bigint, vector array<float>")


def pending(docs: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """(id, hash) of documents whose text hash is not stored for the model."""
    return docs.select("id", text_hash(F.col("text")).alias("hash")).join(stored.where(F.col("model") == model).select("id", "hash"), ["id", "hash"], "left_anti")


def text_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)
