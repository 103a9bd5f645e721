"""MinHash near-dedup with tensored banding.

Two collections of M partial keys, each from T minhashes, stand for M * M tables: table (i, j) is keyed by the pair
(a_i, b_j), so 2 * M * T minhashes do the work of M * M * 2T. A pair with Jaccard similarity s shares a table with
chance (1 - (1 - s^T)^M)^2, 0.9998 at 0.75 and 0.01 at 0.25.

Texts with equal shingle sets are one class, told by a 128-bit digest of the set, and only classes are linked. Two rules
keep the tables few without losing a pair of members: a partial key that no other class has can't take part in a table,
and partial keys of one collection that the same classes hold make the same tables, so one of them stands for all.

A table's members are not all paired. Each is compared with the table's pivot, the member that is in most tables: the
origin of a group of near copies shares more than they do among themselves. Links join components, and a table whose
members are now one component is done. What is left are tables that hold several components, mostly texts with a passage
in common. Their members can be similar across components only if enough of their shingles occur in several, and those
that pass are compared where a prefix filter, which is exact too, allows a similarity. The same steps run at every size;
every comparison counts exact intersections of the full sets, so no link between different texts is lost to the way
pairs are chosen.

Defined results: words and shingles as in ``common`` (A-Z lowered, five words, a shorter text is one shingle). Null or
wordless texts have no shingles and are linked with nothing. Rows that repeat an id are one node. Rows with a null id
join the component of texts with the same set, or have a null component and stay. Empty tables give empty tables; extra
columns, whatever their names, pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import bitmap, bounded_batches, chunks, collected, column, cut, fresh_name, marked, mix, shingles, signed, text_buffer, tidy
from citelake.llm.components import components

#: Partial keys in each of the two collections, and minhashes in a partial key.
M, PER_KEY = 24, 4
SIMILARITY = 75  # per cent

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(99))
_MULTIPLIER = _RNG.integers(1, 2**63, 2 * M * PER_KEY, dtype=np.uint64) * _U(2) + _U(1)
_COMBINE = _RNG.integers(1, 2**63, PER_KEY, dtype=np.uint64) * _U(2) + _U(1)
_TABLE = _RNG.integers(0, 2**63, 2 * M, dtype=np.uint64)


def partial_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 2 * M) partial keys; rows of empty sets mean nothing."""
    full = np.flatnonzero(np.diff(at))
    keys = np.zeros((len(at) - 1, 2 * M), np.uint64)
    if len(full):
        for k in range(2 * M):
            h = np.zeros(len(full), np.uint64)
            for r in range(PER_KEY):
                h += np.minimum.reduceat((sets * _MULTIPLIER[k * PER_KEY + r]) >> _U(32), at[:-1][full]) * _COMBINE[r]
            keys[full, k] = mix(h + _TABLE[k])
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, number of shingles, 128-bit digest of the set, partial keys of both collections."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")), T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                sets, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = partial_keys(sets, at)
                total = [np.zeros(len(sets) + 1, np.uint64), np.zeros(len(sets) + 1, np.uint64)]
                np.cumsum(mix(sets), out=total[0][1:])
                np.cumsum(mix(sets ^ _U(0x5851F42D4C957F2D)), out=total[1][1:])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * M, pa.int32()), pa.array(signed(keys[:, c : c + M].ravel()))) for c in (0, M)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), *(pa.array(signed(t[at[1:]] - t[at[:-1]])) for t in total), *lists], names=["id", "n", "f1", "f2", "a", "b"])

    return bounded_batches(rows).mapInArrow(tidy(run), schema)


def shared_keys(made: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, id, n, second) of every partial key that several classes have; second: of the second collection.

    Keys are counted first; a filter of the shared ones then drops the others before anything else is shuffled.
    """
    full = made.where("n > 0")
    shared = cut(full.select(F.explode(F.concat("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    bits = made.sparkSession.sparkContext.broadcast(bitmap(shared, "key"))
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("f1", "f2", "n", "key")), T.StructField("second", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.column_stack([batch.column(k).flatten().to_numpy().reshape(-1, M) for k in (3, 4)]) if batch.num_rows else np.zeros((0, 2 * M), np.int64)
            row, pos = np.nonzero(marked(bits.value, np.ascontiguousarray(keys).ravel()).reshape(keys.shape))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(keys[row, pos]), pa.array(pos >= M)], names=schema.names)

    live = full.select("f1", "f2", "n", "a", "b").mapInArrow(tidy(run), schema).distinct().join(shared, "key", "left_semi")
    keys = cut(live.join(groups.where("rep IS NOT NULL"), ["f1", "f2", "n"]).select("key", F.col("rep").alias("id"), "n", "second"))
    held = keys.groupBy("key", "second").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("d"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("e")
    )
    holders = held.where("c > 1").select("key", "second", F.xxhash64("second", "c", "d", "e").alias("same"))
    return keys.join(holders, ["key", "second"]).select(F.col("same").alias("key"), "id", "n", "second").distinct()


def tables(keys: DataFrame) -> DataFrame:
    """Rows (k, id, n, w) of the tensored tables over the given keys: key, class, shingles, tables of the class."""
    of = lambda second: F.collect_list(F.when(F.col("second") == second, F.col("key")))
    lists = keys.groupBy("id", "n").agg(of(False).alias("a"), of(True).alias("b"))
    lists = lists.withColumn("w", F.size("a") * F.size("b"))
    one = lists.select("id", "n", "w", F.explode("a").alias("a"), "b")
    return one.select("id", "n", "w", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("k"), "id", "n", "w")


def _may_link(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def member_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the shingle set, as bytes, of every text that is a member of a table."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(members.select(F.xxhash64("id").alias("p")), "p"))
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), F.xxhash64(column(id_col)).alias("p")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(bits.value, batch.column(2).to_numpy())))
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                sets, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(at * 8)), pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), made.cast(pa.binary())], names=["id", "s"])

    made = bounded_batches(rows).mapInArrow(tidy(run), T.StructType([rows.schema["id"], T.StructField("s", T.BinaryType())]))
    return made.join(members.select("id").distinct(), "id", "left_semi")


def named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, s) of the sets that a pair may name: the others are dropped by a filter of ids before a shuffle."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).select(F.xxhash64("id").alias("p"))
    bits = sets.sparkSession.sparkContext.broadcast(bitmap(ids, "p"))
    rows = sets.select("id", "s", F.xxhash64("id").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(bits.value, batch.column(2).to_numpy()), pa.bool_())).select([0, 1])

    return rows.mapInArrow(tidy(run), T.StructType(rows.schema.fields[:2]))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y").select("x", "y", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                merged = np.concatenate([a, b])
                merged.sort()
                same = int(np.count_nonzero(merged[1:] == merged[:-1]))
                ok.append(100 * same >= SIMILARITY * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(tidy(run), T.StructType([pairs.schema["x"], pairs.schema["y"]])).distinct()


def stars(rows: DataFrame) -> DataFrame:
    """(x, y) of each member of a table (k, id, n, w) with the table's pivot, where their sizes allow a link.

    Both sides of the join are dealt by k alone, so a table that holds very many members is split as a skewed join is.
    """
    best = F.max(F.struct("w", F.xxhash64("id").alias("o"), F.col("id").alias("pivot"), F.col("n").alias("m"))).alias("p")
    pivots = rows.groupBy("k").agg(F.count("*").alias("size"), best).where("size > 1").select("k", "p.pivot", "p.m")
    met = rows.join(pivots, "k").where((F.col("id") != F.col("pivot")) & _may_link(F.col("n"), F.col("m")))
    return met.select(*_ordered(F.col("id"), F.col("pivot"))).distinct()


def link(made: DataFrame, groups: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, component) of every class that is linked with another."""
    keys = cut(shared_keys(made, groups))
    rows = collected(cut(tables(keys)))
    sets = cut(member_sets(docs, rows, id_col, text_col))
    tested = collected(cut(stars(rows)))
    links = collected(cut(verify(tested, named(sets, tested))))
    labels = cut(components(links, "x", "y"))
    rest = collected(cut(_open(keys, labels).join(sets, "id")))
    rest, shared, bits = crossing(rest)
    pairs = collected(cut(prefix_pairs(rest, shared, bits).join(tested, ["x", "y"], "left_anti")))
    found = cut(verify(pairs, named(rest, pairs)))
    return components(cut(links.unionByName(found)), "x", "y") if found.take(1) else labels


def _said(rest: DataFrame, names: tuple[str, ...], bits: Broadcast | None = None) -> DataFrame:
    """A row (names, s) for each shingle of each set, or each that the filter may hold."""
    schema = T.StructType([*(rest.schema[c] for c in names), T.StructField("s", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(len(names))]
                own = own if bits is None else [x[marked(bits.value, x)] for x in own]
                at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(names))), pa.array(np.concatenate(own))], names=schema.names)

    return rest.select(*names, "s").mapInArrow(tidy(run), schema)


def crossing(rest: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """The sets that may be similar to one of another component, (s, often) of shingles in several components, and a
    filter of these: exact, from counts of shingles alone.

    Similar sets share SIMILARITY per cent of each, so as many shingles of a set must occur in several components. Texts
    that have only a passage in common end here, before any is compared.
    """
    counts = _said(rest, ("c",)).groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("often"))
    shared = cut(counts.where("lo <> hi").select("s", "often"))
    bits = rest.sparkSession.sparkContext.broadcast(bitmap(shared, "s"))
    k = rest.columns.index("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(k))
            ok = [100 * int(np.count_nonzero(marked(bits.value, h))) >= SIMILARITY * len(h) for h in own]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return cut(rest.mapInArrow(tidy(run), rest.schema)), shared, bits


def prefix_pairs(rest: DataFrame, shared: DataFrame, bits: Broadcast) -> DataFrame:
    """(x, y) of different components that may be similar: exact, without pairing the members of a table.

    Similar sets of n and m shingles share at least need = (n + m) * SIMILARITY / (100 + SIMILARITY). With shingles
    ordered from rare to common, the first that they share has rank n - need + 1 at most in one and m - need + 1 at most
    in the other, so only these heads meet. Shingles of one component alone come first and meet nobody; neither can two
    sets share more than either has beside them. What very many texts share comes last and pairs nobody.
    """
    turn = Window.partitionBy("id").orderBy("often", "s")
    # shingles of one component alone are what is missing from the shared ones
    ranked = _said(rest, ("id", "n", "c"), bits).join(shared, "s")
    ranked = ranked.withColumn("alone", F.col("n") - F.count("*").over(Window.partitionBy("id")))
    ranked = ranked.withColumn("r", F.row_number().over(turn) + F.col("alone"))
    heads = cut(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1))
    heads = heads.select("id", "n", "c", "alone", "r", "s")
    other = heads.select("s", *(F.col(k).alias(f"o_{k}") for k in ("id", "n", "c", "alone", "r")))
    need = F.ceil((F.col("n") + F.col("o_n")) * SIMILARITY / (100 + SIMILARITY))
    enough = F.least(F.col("n") - F.col("alone"), F.col("o_n") - F.col("o_alone")) >= need
    early = (F.col("r") <= F.col("n") - need + 1) & (F.col("o_r") <= F.col("o_n") - need + 1)
    met = heads.join(other, "s").where((F.col("id") < F.col("o_id")) & (F.col("c") != F.col("o_c")) & enough & early)
    return met.select(F.col("id").alias("x"), F.col("o_id").alias("y")).distinct()


def _open(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n, c) of every class that may be in a table with several components: one that has a partial key in each
    collection with members of several components."""
    now = keys.join(labels, "id", "left").select(*keys.columns, F.coalesce("component", "id").alias("c"))
    several = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    held = now.join(several, "key").groupBy("id", "n", "c").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    return held.where("hi AND NOT lo").select("id", "n", "c")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    made = cut(signatures(docs, id_col, text_col))
    full = made.where("n > 0")
    groups = cut(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")))
    labels = link(made, groups, docs, id_col, text_col)
    owners = groups.select("f1", "f2", "n", "rep").join(labels, F.col("rep") == F.col("id"), "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    joined = full.select("id", "n", "f1", "f2").join(owners, ["f1", "f2", "n"]).select("id", "n", "component_id")
    alone = made.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns: one id of each component."""
    gone = fresh_name("gone")
    out = mark(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, column(id_col) == F.col(gone), "left_anti")
