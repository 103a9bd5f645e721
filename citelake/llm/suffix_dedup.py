"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting the suffixes of a whole corpus
is out of reach, so the work is split by content first: the least hash of the k-grams inside a window of LENGTH bytes is
the same wherever the window occurs, so runs of window starts with one least hash form fragments, and equal windows
always lie in fragments of one hash. Hashes that occur once are dropped; fragments with the same bytes are one context
with a count, and a context that occurs twice is repeated as a whole.

Hashes with several contexts go to the kernel. A task cuts the contexts into shards, builds the Burrows-Wheeler
transform of each shard and merges them by interleave refinement: the interleave of the shards' rows starts as their
concatenation, and each pass stably deals it by the two symbols before each suffix, which sorts it two symbols deeper.
Block bounds that appear on a pass are common prefixes of its depth, and a row whose block has no other is settled and
leaves, so after LENGTH symbols the blocks with two or more window starts are the repeated intervals. The suffixes of
the merged collection are never sorted. Contexts whose bytes on both sides of the shared k-gram agree with no other for
LENGTH bytes in all can't hold a repeat and don't enter.

A hash may have any number of contexts (a passage that very many documents share, each with other surroundings). Groups
of more than GROUP contexts are split by content again: windows are told apart by the offset of the k-gram in them, the
range of offsets is halved, and what all windows of a half have in common, which grows with every halving, is the new
key. Pieces that are equal count as one, so a group ends at the latest where the key is the window itself.

Defined results: texts are UTF-8 bytes, null is empty; texts under LENGTH bytes lose nothing; matches never cross
documents; repeated rows are repeats of each other; rows with a null id are treated like others; texts of any length are
read in windows of CHUNK_BYTES; empty tables give empty tables. Equality is decided on bytes; a context is then named by
its hash and 64 bits of a BLAKE2 digest, a text by 64 bits of one and its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import CHUNK_BYTES, bitmap, bounded_batches, chunks, column, cut, marked, mix, prefix_hash, signed, text_buffer, tidy

LENGTH = 200
GRAM = 48
#: Window starts in a fragment at most.
RUN = 160
#: Bytes of contexts that the kernel takes at once, and bytes in a shard: small, since each pass should stay in cache.
BLOCK_BYTES, SHARD_BYTES = 128 << 10, 64 << 10
#: Contexts that a task compares at once; larger groups are split by content.
GROUP = 1024

_U = np.uint64


def _digest(s: bytes) -> int:
    return int.from_bytes(blake2b(s, digest_size=8).digest(), "little", signed=True)


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each fragment: least hash, text, first window start (in data), number of starts, place of the first k-gram with
    that hash after the first start, and whether there are more."""
    n, width = len(data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), empty, empty, empty, empty, empty > 0
    total, inverse = prefix_hash(data)
    h = mix((total[gram:] - total[: n - gram + 1]) * inverse[: n - gram + 1])
    pad = -len(h) % width
    grid = np.concatenate([h, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    size = np.diff(offsets)
    valid = np.maximum(size - length + 1, 0)
    at = np.zeros(len(valid) + 1, np.int64)
    np.cumsum(valid, out=at[1:])
    text = np.repeat(np.arange(len(valid)), valid)
    p = np.arange(at[-1]) - at[text] + offsets[text]
    least = least[p]
    fresh = np.ones(len(p), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    long = np.diff(np.append(begin, len(p)))
    pieces = -(-long // RUN)
    begin = np.repeat(begin, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    m = np.diff(np.append(begin, len(p)))
    value, p = least[begin], p[begin]
    if not len(p):
        return value, empty, empty, empty, empty, empty > 0
    # the k-grams that can be the least of a fragment, and those of each fragment
    low = np.flatnonzero(h <= value.max())
    first = np.searchsorted(low, p)
    held = np.searchsorted(low, p + m + width - 1) - first
    at = np.cumsum(held) - held
    where = low[np.repeat(first - at, held) + np.arange(held.sum())]
    same = h[where] == np.repeat(value, held)
    lead = where[np.flatnonzero(same)[np.searchsorted(np.flatnonzero(same), at)]]
    return value, text[begin], p, m, lead - p, np.add.reduceat(same, at) > 1


def windowed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], int]]:
    """Bytes, their fragments and the place of the bytes in a text, of a chunk; a longer text comes in windows."""
    if len(offsets) > 2 or len(data) <= CHUNK_BYTES + LENGTH:
        yield data, fragments(data, offsets), 0
        return
    for a in range(0, len(data) - LENGTH + 1, CHUNK_BYTES):
        part = data[a : a + CHUNK_BYTES + LENGTH - 1]
        yield part, fragments(part, np.array([0, len(part)])), a


def shard_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of a collection, in sorted order: the two symbols before it as one number (0 if there are fewer), the
    row of the suffix that begins with them, its string and its offset there.

    Every string ends in a terminator of its own, smaller than all bytes, ordered as the strings are.
    """
    size = np.array([len(s) + 1 for s in strings])
    at = np.concatenate([[0], np.cumsum(size)])
    n, m, end = int(at[-1]), len(strings), at[1:] - 1
    body = np.ones(n, dtype=bool)
    body[end] = False
    text = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    symbol = np.zeros(n, np.int64)  # for sorting: terminators 0 to m - 1, then bytes
    symbol[body] = text + m
    symbol[end] = np.arange(m)
    base, depth = m + 257, 4 if m < 40_000 else 1
    rank = np.zeros(n, np.int64)
    for k in range(depth):
        rank *= base
        rank[: n - k] += symbol[k:]
    order = np.argsort(rank, kind="stable")
    while True:
        # a suffix that ends within depth symbols is told by its terminator, so shared ranks always reach further
        ordered = rank[order]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(fresh) - 1
        if group[-1] == n - 1:
            break
        dense = np.empty(n, np.int64)
        dense[order] = group
        shared = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
        rows = order[shared]
        key = dense[rows] * (n + 1) + dense[rows + depth]
        order[shared] = rows[np.argsort(key, kind="stable")]
        rank = dense * (n + 1)
        rank[rows] = key
        depth *= 2
    owner = np.repeat(np.arange(m), size)[order]
    place = order - at[owner]
    raised = np.zeros(n, np.int64)
    raised[body] = text + 1
    top = 256 if not len(text) or text.max() < 255 else 257
    pair = np.where(place > 1, raised[order - 2] * top + raised[order - 1], 0)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    back = np.where(place > 1, row[order - 2], 0)
    return pair.astype(np.uint16 if top == 256 else np.int32), back, owner, place


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows, counted through all shards, whose first depth symbols another row has too, sorted by these, and the
    number of the block of each; depth is even.

    shards: pairs of symbols before each suffix and the rows of the suffixes that begin with them, as of ``shard_bwt``.
    """
    if depth % 2:
        raise ValueError("depth must be even")
    first = np.cumsum([0, *(len(pair) for pair, _ in shards)])
    pair = np.concatenate([p for p, _ in shards])
    back = np.concatenate([b + k for (_, b), k in zip(shards, first, strict=False)])
    z = np.arange(len(pair))
    block = np.zeros(len(pair), np.int32)
    for _ in range(depth // 2):
        before = pair[z]
        order = np.argsort(before, kind="stable")
        before = before[order]
        gone = int(np.searchsorted(before, 1))  # nothing starts two symbols before these
        order, before = order[gone:], before[gone:]
        z, old = back[z[order]], block[order]
        fresh = np.ones(len(z) + 1, dtype=bool)
        fresh[1:-1] = (before[1:] != before[:-1]) | (old[1:] != old[:-1])
        shared = ~(fresh[:-1] & fresh[1:])
        block, z = np.cumsum(fresh[:-1], dtype=np.int32)[shared], z[shared]
        if not len(z):
            break
    return z, block


def repeated_starts(strings: list[bytes], starts: list[int], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string, which of its first ``starts`` windows of length bytes also start elsewhere in the strings."""
    shards, owners, places, first = [], [], [], 0
    while first < len(strings):
        last, size = first, 0
        while last < len(strings) and (last == first or size + len(strings[last]) < shard_bytes):
            size += len(strings[last])
            last += 1
        pair, back, owner, place = shard_bwt(strings[first:last])
        shards.append((pair, back))
        owners.append(owner + first)
        places.append(place)
        first = last
    z, block = merge(shards, length)
    owner, place = np.concatenate(owners)[z], np.concatenate(places)[z]
    counted = np.array(starts)
    is_start = place < counted[owner]
    several = np.bincount(block[is_start], minlength=int(block[-1]) + 1 if len(block) else 1) > 1
    hit = is_start & several[block]
    at = np.concatenate([[0], np.cumsum(counted)])
    flags = np.zeros(int(at[-1]), dtype=bool)
    flags[at[owner[hit]] + place[hit]] = True
    return [flags[a:b] for a, b in zip(at, at[1:], strict=False)]


def _spread(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).alias("id"), column(text_col).alias("text"))


def repeated_hashes(rows: DataFrame) -> DataFrame:
    """Least hashes of more than one fragment in the corpus, or of one that may repeat inside."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                for _, (h, *_, inner), _ in windowed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    value, n = np.unique(np.concatenate([h, h[inner]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n)], names=["h", "n"])

    made = bounded_batches(rows).mapInArrow(tidy(counted), "h bigint, n bigint")
    return made.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def occurrences(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(h, c, id, t, p, m, g, inner, s): hash, digest of the bytes, id and digest of the text, first start, number of
    starts, place of the k-gram, whether it comes again, bytes."""
    long = ("h", "c", "t", "p", "m", "g")
    schema = T.StructType([rows.schema["id"], *(T.StructField(k, T.LongType()) for k in long), T.StructField("inner", T.BooleanType()), T.StructField("s", T.BinaryType())])
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def fragmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                chunk, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                t = np.zeros(j - i, np.int64)
                told = np.zeros(j - i, dtype=bool)
                whole = chunk.tobytes()
                for part, (h, text, p, m, g, inner), shift in windowed(chunk, at):
                    keep = marked(shared.value, h)
                    h, text, p, m, g, inner = (x[keep] for x in (h, text, p, m, g, inner))
                    for k in np.unique(text[~told[text]]).tolist():
                        t[k], told[k] = _digest(whole[at[k] : at[k + 1]]), True
                    raw = part.tobytes() if part is not chunk else whole
                    s = [raw[a:b] for a, b in zip(p.tolist(), (p + m + LENGTH - 1).tolist(), strict=True)]
                    c = np.array([_digest(x) for x in s], np.int64)
                    numbers = (signed(h), c, t[text], p + shift - at[text], m, g)
                    ids = batch.column(0).slice(i, j - i).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers), pa.array(inner), pa.array(s, pa.binary())], names=schema.names)

    return bounded_batches(rows).mapInArrow(tidy(fragmented), schema)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _agreeing(parts: list[bytes]) -> np.ndarray:
    """Of each part: the bytes at its start that it shares with some other one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = np.zeros(len(parts), np.int64)
    for i, j in zip(order, order[1:], strict=False):
        n = min(len(parts[i]), len(parts[j]))
        x = int.from_bytes(parts[i][:n], "big") ^ int.from_bytes(parts[j][:n], "big")
        same = n - (x.bit_length() + 7) // 8
        out[i], out[j] = max(out[i], same), max(out[j], same)
    return out


def promising(contexts: list[tuple[bytes, int, bool]], length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """The contexts (bytes, place of the k-gram, whether it comes again) of one hash that may hold a repeated window.

    Where the k-gram comes once, equal windows have it at one offset, so what lies to its left and right must agree for
    length bytes in all with what other contexts have there.
    """
    if any(inner for *_, inner in contexts):
        return list(range(len(contexts)))
    left, right = _agreeing([s[:g][::-1] for s, g, _ in contexts]), _agreeing([s[g + gram :] for s, g, _ in contexts])
    return np.flatnonzero(left + right + gram >= length).tolist()


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, h, c, a, m, g, inner, s), sorted by key, to runs (h, c, a, b) of repeated starts a to b - 1."""
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        found = repeated_starts([x[-1] for x in held], [x[4] for x in held])
        out = [(h, c, at + a, at + b) for (_, h, c, at, *_), flags in zip(held, found, strict=True) for a, b in _runs(flags)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["h", "c", "a", "b"])

    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True))
    size = 0
    for _, group in groupby(rows, key=itemgetter(0)):
        group = list(group)
        for k in promising([(s, g, inner) for *_, g, inner, s in group]):
            held.append(group[k])
            size += len(group[k][-1])
        if size > BLOCK_BYTES:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (h, c, a, m, g, lo, hi, s), of windows with their k-gram at an offset from lo to hi, to those of each half of
    this range, with the key that all windows of the half share."""
    for batch in batches:
        out = []
        for h, c, a, m, g, lo, hi, s in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            gram, start = s[g : g + GRAM], 0
            while start < m:  # windows up to the next k-gram, which is the first in each of them
                stop = min(m, g + 1)
                for low, high in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
                    first, last = max(start, g - high), min(stop - 1, g - low)
                    if low <= high and first <= last:
                        core = s[g - low : g - high + LENGTH]
                        key = _digest(h.to_bytes(8, "little", signed=True) + bytes([low, high]) + core)
                        out.append((key, h, c, a + first, last - first + 1, g - first, low, high, s[first : last + LENGTH]))
                start, g = stop, s.find(gram, g + 1)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary() if k == 8 else pa.int64()) for k in range(9)], names=["key", "h", "c", "a", "m", "g", "lo", "hi", "s"])


def grouped(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces (key, h, c, a, m, g, inner, s) in groups of at most GROUP, and runs (h, c, a, b) known to be repeated.

    contexts: h, c, m, g, inner, s, n, several to a hash or with a repeated k-gram.
    """
    size = contexts.groupBy("h").agg(F.count("*").alias("contexts"))
    several = contexts.join(size, "h").where("contexts > 1 OR inner AND n = 1")
    zero = F.lit(0).cast("long")
    small = several.where(F.col("contexts") <= GROUP)
    ready = small.select(F.col("h").alias("key"), "h", "c", zero.alias("a"), "m", "g", "inner", "s")
    known = contexts.where("n > 1").select("h", "c", zero.alias("a"), F.col("m").alias("b"))
    whole = F.lit(LENGTH - GRAM).cast("long")
    large = several.where(F.col("contexts") > GROUP).select("h", "c", zero.alias("a"), "m", "g", zero.alias("lo"), whole.alias("hi"), "s")
    large = cut(large)
    fields = "key bigint, h bigint, c bigint, a bigint, m bigint, g bigint, lo bigint, hi bigint, s binary"
    while not large.isEmpty():
        pieces = cut(large.mapInArrow(tidy(_halves), fields))
        one = F.min(F.struct("h", "c", "a", "m", "g", "lo", "hi")).alias("one")
        distinct = cut(pieces.groupBy("key", "s").agg(F.count("*").alias("n"), one))
        equal = pieces.join(distinct.where("n > 1").select("key", "s"), ["key", "s"], "left_semi")
        known = known.unionByName(equal.select("h", "c", "a", (F.col("a") + F.col("m")).alias("b")))
        size = distinct.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1")
        left = cut(distinct.select("key", "s", "one.*").join(size, "key"))
        fit = left.where(F.col("contexts") <= GROUP)
        # a k-gram that comes again in a piece may align it in another way
        again = F.expr(f"position(substring(s, g + 1, {GRAM}), s, g + 2) > 0")
        ready = ready.unionByName(fit.select("key", "h", "c", "a", "m", "g", again.alias("inner"), "s"))
        large = left.where(F.col("contexts") > GROUP).select("h", "c", "a", "m", "g", "lo", "hi", "s")
    return ready, known


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, spans): the byte ranges array<struct<a, b>> that repeated strings cover, of each text that has any."""
    rows = _spread(docs, id_col, text_col)
    hashes = cut(repeated_hashes(rows))
    found = occurrences(rows, bitmap(hashes, "h")).join(hashes, "h", "left_semi")
    contexts = cut(found.groupBy("h", "c", "m", "g", "inner", "s").agg(F.count("*").alias("n")))
    ready, known = grouped(contexts)
    runs = ready.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_kernel), "h bigint, c bigint, a bigint, b bigint")
    told = known.unionByName(runs).groupBy("h", "c").agg(F.collect_set(F.struct("a", "b")).alias("r"))
    shift = F.transform("r", lambda x: F.struct((F.col("p") + x["a"]).alias("a"), (F.col("p") + x["b"] + LENGTH - 1).alias("b")))
    covered = found.select("h", "c", "id", "t", "p").join(told, ["h", "c"]).select("id", "t", shift.alias("r"))
    return covered.groupBy("id", "t").agg(F.flatten(F.collect_set("r")).alias("spans"))


def text_digest(rows: DataFrame, touched: np.ndarray) -> DataFrame:
    """rows with t, the digest of the text, and whether the filter holds it."""
    shared = rows.sparkSession.sparkContext.broadcast(touched)
    schema = T.StructType([*rows.schema.fields, T.StructField("t", T.LongType()), T.StructField("touched", T.BooleanType())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            t = np.array([_digest(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t), pa.array(marked(shared.value, t.view(np.uint64)))], names=schema.names)

    return bounded_batches(rows).mapInArrow(tidy(digested), schema)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to what is left and its figures."""
    for batch in batches:
        kept, figures = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = (text or "").encode()
            step = np.zeros(len(raw) + 1, np.int32)
            if spans.is_valid:
                a, b = (spans.values.field(k).to_numpy() for k in (0, 1))
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
            gone = np.cumsum(step)[:-1] > 0
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw)
            figures.append((len(raw), int(gone.sum()), len(_runs(gone))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array([x[k] for x in figures], pa.int64()) for k in range(3))], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    rows = _spread(docs, id_col, text_col)
    spans = cut(repeats(docs, id_col, text_col))
    told = text_digest(rows, bitmap(spans, "t"))
    schema = T.StructType([rows.schema["id"], T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    hit = told.where("touched").alias("d").join(spans.alias("s"), F.expr("d.id <=> s.id AND d.t = s.t"), "left").select("d.id", "d.text", "s.spans")
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    return hit.unionByName(told.where("NOT touched").select("id", "text", none)).mapInArrow(tidy(_strip), schema)
