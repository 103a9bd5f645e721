"""Document quality by a regularised quadratic discriminant.

Every text becomes a vector of transformed statistics (lengths, kinds of characters, repetition). Each class has a mean
and a covariance shrunk towards a multiple of the identity; a score is the logistic of the difference of the two log
densities, taken as Mahalanobis distances through Cholesky factors that are computed once.

Defined results: null counts as empty text and is scored like any; without labelled rows of both classes the score is
the prior; a null id is in no fold (held_out null); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import column, bounded_batches, chunks, cut, fresh_name, mix, prefix_hash, shingles, text_buffer, word_hashes, words
from citelake.llm.labels import fold, one_per_id

FOLDS = 3
#: Weight of the identity in a class covariance.
SHRINKAGE = 0.02

_KIND = np.full(256, 8, dtype=np.uint8)  # other ASCII symbols
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"|")):
    _KIND[list(_chars)] = _k
_KIND[128:] = 9
_KINDS = 10
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
NAMES = (
    "bytes", "words", "word_bytes", "distinct_words", "distinct_shingles", "lines", "distinct_lines", "repeats", "top_word",
    "upper", "digit", "newline", "punctuation", "exclamation", "pipe", "symbol", "high",
)


def _distinct_per_text(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest multiplicity in each text."""
    n = len(at) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    h = h.copy()
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[at[:-1][np.diff(at) > 0]] = True
    begins = np.flatnonzero(fresh)
    cut_at = np.searchsorted(begins, at)
    sizes = np.diff(np.append(begins, len(h)))
    top = np.zeros(n)
    full = np.flatnonzero(np.diff(cut_at))
    top[full] = np.maximum.reduceat(sizes, cut_at[:-1][full])
    return np.diff(cut_at).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text, in the order of NAMES."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n, dtype=np.int64) * _KINDS, size) + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    first, last, at = words(data, offsets)
    h = word_hashes(data, first)
    count = np.diff(at).astype(float)
    distinct, top = _distinct_per_text(h, at)
    owner = np.repeat(np.arange(n), np.diff(at))
    again = np.bincount(owner[1:], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]), n) if len(h) else np.zeros(n)
    word_bytes = np.bincount(owner, last - first, n) if len(h) else np.zeros(n)
    sets, set_at = shingles(data, offsets)
    a, b, line_at = words(data, offsets, _NEWLINE)
    total, inverse = prefix_hash(data)
    lines, _ = _distinct_per_text(mix((total[b] - total[a]) * inverse[a]) if len(a) else np.zeros(0, np.uint64), line_at)
    per_word = lambda k: np.sqrt(kinds[:, k] / np.maximum(count, 1))
    per_byte = lambda k: np.sqrt(kinds[:, k] / np.maximum(size, 1))
    share = lambda x: np.sqrt(x / np.maximum(count, 1))
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(word_bytes / np.maximum(count, 1)), np.log1p(distinct), np.log1p(np.diff(set_at)), np.log1p(np.diff(line_at)), np.log1p(lines), share(again), share(top),
        per_byte(0), per_byte(2), per_word(4), per_byte(5), per_word(6), per_word(7), per_word(8), per_byte(9),
    ])


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the Cholesky factors
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.center) / self.scale
        far = [((x - m) @ c.T) ** 2 for m, c in zip(self.means, self.inverses, strict=True)]
        z = self.offset + 0.5 * (far[0].sum(1) - far[1].sum(1)) if far else np.full(len(x), self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def featurise(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """docs without the text, with an array<double> column of statistics; narrow."""
    tmp = fresh_name("stats")
    rest = [c for c in docs.columns if c not in (text_col, out)]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(tmp, T.ArrayType(T.DoubleType(), False), False)])
    docs = docs.select(*rest, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(rest)))
            x = np.zeros((batch.num_rows, len(NAMES)))
            for i, j in chunks(offsets):
                x[i:j] = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], made], names=[*rest, tmp])

    return bounded_batches(docs).mapInArrow(run, schema).withColumnRenamed(tmp, out)


def train(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Fit on all rows (label, stats): only sums of statistics and of their products leave the executors."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                held[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], held.shape[1])), pa.array(np.tile(np.arange(held.shape[1]), 2)), pa.array(held.ravel())], names=["label", "k", "v"])

    total = np.zeros((2, 1 + d + d * d))
    for r in rows.select("label", "stats").mapInArrow(sums, "label bigint, k bigint, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        total[r["label"], r["k"]] = r["v"]
    n = total[:, 0]
    if not n.all():
        return Model(np.zeros(d), np.ones(d), [], [], float(np.clip(np.log((n[1] + 1e-9) / (n[0] + 1e-9)), -35, 35)) if n.any() else 0.0)
    both = total.sum(0)
    center = both[1 : d + 1] / both[0]
    scale = np.sqrt(np.maximum(np.diag(both[d + 1 :].reshape(d, d)) / both[0] - center**2, 1e-12))
    means, inverses, offset = [], [], float(np.log(n[1] / n[0]))
    for k, sign in ((0, 1), (1, -1)):
        raw = total[k, 1 : d + 1] / n[k]
        cov = (total[k, d + 1 :].reshape(d, d) / n[k] - np.outer(raw, raw)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append((raw - center) / scale)
        inverses.append(np.linalg.inv(factor))
        offset += sign * float(np.log(np.diag(factor)).sum())
    return Model(center, scale, means, inverses, offset)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, held_out: int = 1, shrinkage: float = SHRINKAGE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. One pass over the texts; labels meet statistics only."""
    rows = cut(featurise(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))))
    known = one_per_id(labels, id_col, label_col).where(fold("label_id", folds) != held_out)
    model = train(rows.join(known, rows["doc_id"] == known["label_id"]), shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    made = rows.select("doc_id", "stats").mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return made.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
