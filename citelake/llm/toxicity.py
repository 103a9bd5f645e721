"""Toxicity by a factorization machine over hashed terms.

A document is the set of hash buckets of its terms: lower-cased words and their beginnings of 4 to 6 bytes. On a
sample of labelled documents a factorization machine is fitted on all buckets that occur in it: a bias, a weight for
each bucket and a low-rank weight for each pair of buckets, so that terms that are harmless alone can count together.
A bucket that the sample does not hold has no weight.

Defined results: a null or empty text scores the bias; without labelled rows of both classes every score is the prior
(0 without any rows); a null id is held out by no fold (held_out null); of rows that repeat a labelled id one is learned
from; rows and extra columns, whatever their names, pass through ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import _LOWER, bounded_batches, chunks, column, cut, fresh_name, give_back, mapped, mix, prefix_hash, text_buffer, tidy, words
from citelake.llm.labels import fold, one_per_id

#: Labelled documents that a model is fitted on at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
#: Hash buckets of terms.
BUCKET_BITS = 20
#: Standard deviations by which the share of a bucket differs between the classes if it is fitted first.
MIN_Z = 5.0
#: Passes over the sample, and mini-batches at least; DAMP and HOLD hold back steps of buckets with few gradients so far.
FACTORS, EPOCHS, MIN_STEPS, BATCH, RATE, DAMP, HOLD, L2 = 8, 6, 1000, 256, 0.3, 1.0, 3.0, 1e-4
PREFIXES = (4, 5, 6)
FOLDS = 5
#: Rows of parameters that a fitted model is handed on in at a time.
PIECE = 1 << 15

_U = np.uint64
_BREAK = np.ones(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_a:_b] = False
_TABLE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)[_LOWER]


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term buckets of each text with repeats, and the text of each."""
    first, last, at = words(data, offsets, _BREAK)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    total, inverse = prefix_hash(data, _TABLE)
    ids, owners = [], []
    for k in (0, *PREFIXES):
        rows = slice(None) if k == 0 else np.flatnonzero(last - first > k)
        a = first[rows]
        h = (total[last[rows] if k == 0 else a + k] - total[a]) * inverse[a]
        ids.append((mix(h + _U(k)) >> _U(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[rows])
    return np.concatenate(ids), np.concatenate(owners)


def _distinct(ids: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(owners << BUCKET_BITS | ids)
    return keys & ((1 << BUCKET_BITS) - 1), keys >> BUCKET_BITS


@dataclass
class Model:
    bias: float
    slot: np.ndarray  # of each bucket: its row of the parameters, or -1
    params: np.ndarray  # a row for each bucket seen: its weight, then its factors

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        ids, owner = _distinct(*buckets(data, offsets))
        slot = self.slot[ids]
        kept = slot >= 0
        z = np.full(n, self.bias)
        if kept.any():
            texts, start = np.unique(owner[kept], return_index=True)
            z[texts] += _raw(self.params[slot[kept]], start)[0]
        return _sigmoid(z)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _raw(rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pairs of each text, and its sums of factors, from the parameters of its buckets; no text is empty."""
    sums = np.add.reduceat(rows, start, axis=0)
    squares = np.add.reduceat(np.einsum("ij,ij->i", rows[:, 1:], rows[:, 1:]), start)
    return sums[:, 0] + 0.5 * (np.einsum("ij,ij->i", sums[:, 1:], sums[:, 1:]) - squares), sums


def _fit(slot: np.ndarray, at: np.ndarray, y: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Bias and parameters of all buckets. slot: of text k from at[k] to at[k + 1].

    Buckets that tell the classes apart alone are fitted first, as each text has many rare ones that could explain it as
    well; all buckets then start from there and learn what is left, such as pairs of terms that are harmless alone.
    """
    rng = np.random.Generator(np.random.PCG64(5))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, params = float(np.log(rate / (1 - rate))), np.zeros((size, 1 + FACTORS), np.float32)
    params[:, 1:] = rng.normal(0, 0.01, (size, FACTORS))
    n, n1 = np.zeros(size), np.zeros(size)
    for k in range(0, len(y), 512):  # texts at a time: bincount takes 8 bytes for each of their buckets
        texts = slice(k, k + 512)
        own = slot[at[k] : at[min(k + 512, len(y))]]
        n += np.bincount(own, minlength=size)
        n1 += np.bincount(own[np.repeat(y[texts] > 0, np.diff(at[k : min(k + 512, len(y)) + 1]))], minlength=size)
    p = (n + 1) / (len(y) + 2)
    z = (n1 / y.sum() - (n - n1) / (len(y) - y.sum())) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (len(y) - y.sum())))
    clear = (np.abs(z) >= MIN_Z)[slot]
    bias, params = _descend(slot[clear], np.searchsorted(np.flatnonzero(clear), at), y, bias, params, rng)
    # many buckets of a text move at once: held back so that one text can't swing its own score
    return _descend(slot, at, y, bias, params, rng, (HOLD * RATE * len(slot) / len(y)) ** 2)


def _descend(slot: np.ndarray, at: np.ndarray, y: np.ndarray, bias: float, params: np.ndarray, rng: np.random.Generator, damp: float = DAMP) -> tuple[float, np.ndarray]:
    """Logistic loss, mini-batches of texts that are not empty, Adagrad."""
    past, past_bias = np.full_like(params, max(damp, DAMP)), max(damp, DAMP)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return bias, params
    batches = -(-len(full) // BATCH)
    passes = max(EPOCHS, -(-MIN_STEPS // batches))
    for turns in range(passes):
        left = 1 - turns / passes
        turn = rng.permutation(full)
        for k in range(0, len(turn), BATCH):
            texts = turn[k : k + BATCH]
            long = at[texts + 1] - at[texts]
            start = np.cumsum(long) - long
            used, where = np.unique(slot[np.repeat(at[texts] - start, long) + np.arange(long.sum())], return_inverse=True)
            mine = params[used]
            z, sums = _raw(mine[where], start)
            g = _sigmoid(bias + z) - y[texts]
            sums[:, 0] = 1
            each = np.repeat((g[:, None] * sums).astype(np.float32), long, axis=0)
            grad = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(1 + FACTORS)], axis=1).astype(np.float32)
            grad[:, 1:] -= grad[:, :1] * mine[:, 1:]
            grad += L2 * mine
            past[used] += grad * grad
            params[used] = mine - left * RATE * grad / np.sqrt(past[used])
            past_bias += g.sum() ** 2
            bias -= left * RATE * g.sum() / past_bias**0.5
    return float(bias), params


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bias, buckets and parameters, in pieces, of the model of all rows (label, buckets as bytes)."""
    labels, long, parts = [np.zeros(0)], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1)]
        labels.append(batch.column(0).to_numpy().astype(float))
        long.append(np.array([len(x) for x in own], np.int64))
        parts += own and [np.concatenate(own)]
    y, at, ids = np.concatenate(labels), np.cumsum(np.concatenate(long)), np.concatenate(parts)
    del parts
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[ids] = 0
    seen = np.flatnonzero(slot == 0)
    slot[seen] = np.arange(len(seen))
    if not y.any() or y.all():
        bias, seen, params = -35.0 if not y.any() else 35.0, seen[:0], np.zeros((0, 1 + FACTORS), np.float32)
    else:
        ids = slot[ids]
        bias, params = _fit(ids, at, y, len(seen))
    for k in range(0, max(1, len(seen)), PIECE):
        piece = slice(k, k + PIECE)
        yield pa.RecordBatch.from_pydict({"bias": [bias], "seen": [seen[piece].astype(np.int32).tobytes()], "params": [params[piece].tobytes()]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, folds: int = FOLDS) -> Model:
    """Fit on at most max_rows labelled documents outside fold 0, in one task: the driver gets the model alone."""
    chosen = one_per_id(labels, id_col, label_col).where(fold("label_id", folds) != 0).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    sample = cut(docs.select(column(id_col).alias("label_id"), column(text_col).alias("text")).join(F.broadcast(chosen), "label_id").groupBy("label_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in chunks(offsets):
                ids, owner = _distinct(*buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                at = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32) * 4
                own = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(ids.astype(np.int32))])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), own], names=["label", "buckets"])

    rows = cut(bounded_batches(sample).mapInArrow(tidy(features), "label int, buckets binary"))
    made = rows.coalesce(1).mapInArrow(tidy(_fitted), "bias double, seen binary, params binary").toArrow()
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    if not made.num_rows:
        return Model(-35.0, slot, np.zeros((0, 1 + FACTORS), np.float32))
    seen, params = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in made.column(c)]) for c, kind in (("seen", np.int32), ("params", np.float32)))
    bias = made.column("bias")[0].as_py()
    del made
    slot[seen] = np.arange(len(seen))
    give_back()
    return Model(bias, slot, params.reshape(-1, 1 + FACTORS))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column from 0 to 1; narrow."""
    tmp = fresh_name("score")
    k = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(k))
            s = np.zeros(batch.num_rows)
            for i, j in chunks(offsets):
                s[i:j] = m.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, tmp])

    made = mapped(docs, run, [T.StructField(tmp, T.DoubleType(), False)])
    return made.drop(*[c for c in docs.columns if c == out]).withColumnRenamed(tmp, out)


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns."""
    tmp = fresh_name("score")
    return score(docs, train(docs, labels, text_col=text_col), text_col, tmp).where(F.col(tmp) < threshold).drop(tmp)
