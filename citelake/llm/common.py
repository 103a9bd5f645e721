"""Shared pieces of the corpus operators: checkpoints, Arrow text buffers, word hashes and shingle sets.

Word kernels work on UTF-8 bytes: white space is 0x20 and 0x09-0x0D, lower-casing touches A-Z only, so neither can
split a multi-byte character.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a numpy kernel takes at once; a longer single text is taken whole.
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
#: Bits of a filter of hashes that goes to the executors: 4 MB, whatever the number of hashes.
FILTER_BITS = 25
SHINGLE_WORDS = 5

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER_BYTE = _BYTE[_LOWER]  # of words: white space adds nothing
_LOWER_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)
_POW = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session's context has or spark.checkpoint.dir names.

    Only a local session, whose executors are this machine, gets a folder of its own where none is named.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="citelake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session held to BATCH_BYTES: texts may be long, rows say nothing of memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def mapped(df: DataFrame, run: Kernel, fields: list[T.StructField]) -> DataFrame:
    """df through a kernel that appends columns. Names with dots, which Arrow maps can't take, are kept out of its way."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    made = bounded_batches(plain).mapInArrow(tidy(run), T.StructType([*plain.schema.fields, *fields]))
    return made.toDF(*df.columns, *(f.name for f in fields))


def tidy(run: Kernel) -> Kernel:
    """run, giving freed memory back to the system at the end of a partition: workers live on beside those of others."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def collected(df: DataFrame) -> DataFrame:
    """df, after the driver's JVM has dropped its garbage: of plans and tasks that are done, and with it the shuffles and
    checkpoints that nothing names any more. A chain of many jobs else fills the heap before it is collected."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def column(name: str) -> Column:
    """The column of just this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(prefix: str) -> str:
    return f"_{prefix}_{uuid.uuid4().hex[:8]}"


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contiguous UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset :] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, _U(base), dtype=np.uint64)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative polynomial hash (length n + 1) and the inverse powers that align a difference to its start."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    return total, inverse


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word between breaking bytes, and the first word of each text (length texts + 1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~breaks[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, lower-cased."""
    if not len(first):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    return mix(np.add.reduceat(_LOWER_BYTE[data] * power[: len(data)], first) * inverse[first])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct width-word shingle hashes of each text, ascending, and their offsets; a shorter text is one shingle."""
    first, _, at = words(data, offsets)
    h = word_hashes(data, first)
    texts, count = len(at) - 1, np.diff(at)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    total = max(len(h) - width + 1, 0)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(width):
        rolled[:total] += h[k : k + total] * _MIX[k]
    owner = np.repeat(np.arange(texts), made)
    position = np.arange(out[-1]) - out[owner] + at[owner]
    short = np.flatnonzero((count > 0) & (count < width))
    for t in short:
        rolled[at[t] : at[t] + 1] = (h[at[t] : at[t + 1]] * _MIX[: count[t]]).sum(keepdims=True) + _MIX[8:9] * _U(count[t])
    s = mix(rolled[position])
    for t in range(texts):
        s[out[t] : out[t + 1]].sort()
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = s[1:] != s[:-1]
    fresh[out[:-1][made > 0]] = True
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return s[fresh], kept[out]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def with_schema(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    arrays, names = list(batch.columns), list(batch.schema.names)
    for k, v in columns.items():
        arrays.append(v)
        names.append(k)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the slots of a column of hashes: a filter without false negatives, of a size that does not grow."""
    p = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = keys.select(p.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[bits.column("w").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    p = keys.view(np.int64) & ((1 << FILTER_BITS) - 1)
    return (bits[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1
