"""Graph algorithms as iterated DataFrames."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85, personal: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(id, score), summing to 1. edges: src, dst, optional weight. Dangling mass goes to the teleport vector.

    Every step is one materialised table, so its plan is as long as the first one's: edges are joined with the scores of
    their sources, sums by target with the scores before; the dangling sum of a step is one number, taken from it. With a
    tolerance the steps end when all scores together moved by less than tolerance times the number of nodes.
    """
    edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    edges = checkpointed(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")))
    with few_partitions(edges) as parts:
        return _pagerank(nodes, edges.repartition(parts, "src").persist(), iterations, damping, personal, tolerance)


@contextlib.contextmanager
def few_partitions(rows: DataFrame, each: int = 200_000):
    """The number of partitions that rows fill, which shuffles have meanwhile: for loops over one table, whose every step
    would else be as many tasks as the session has shuffle partitions, most of them tiny."""
    spark, name = rows.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    parts = max(spark.sparkContext.defaultParallelism, rows.count() // each + 1)
    spark.conf.set(name, str(parts))
    try:
        yield parts
    finally:
        spark.conf.set(name, before)


def _pagerank(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float, personal: DataFrame | None, tolerance: float | None) -> DataFrame:
    if personal is None:
        n = nodes.count()
        base = nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("p"))
    else:
        k = personal.count()
        base = nodes.join(personal.select("id", F.lit(1.0 / k).alias("q")), "id", "left").select("id", F.coalesce("q", F.lit(0.0)).alias("p"))
    known = edges.select(F.col("src").alias("id"), F.lit(False).alias("dangling")).distinct()
    ranks = checkpointed(base.join(known, "id", "left").select("id", F.col("p").alias("score"), F.coalesce("dangling", F.lit(True)).alias("dangling"), "p", F.lit(0.0).alias("moved")))
    told = (F.sum(F.when(F.col("dangling"), F.col("score"))).alias("lost"), F.sum("moved").alias("moved"), F.count("*").alias("n"))
    for turn in range(iterations):
        now = ranks.agg(*told).first()
        if turn and tolerance is not None and (not now["n"] or now["moved"] < tolerance * now["n"]):
            break
        lost = now["lost"] or 0.0
        given = edges.join(ranks.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("part")).alias("given"))
        score = damping * (F.coalesce("given", F.lit(0.0)) + F.lit(lost) * F.col("p")) + (1 - damping) * F.col("p")
        ranks = checkpointed(ranks.join(given, "id", "left").select("id", score.alias("now"), "dangling", "p", F.abs(score - F.col("score")).alias("moved")).withColumnRenamed("now", "score"))
    edges.unpersist()
    return ranks.select("id", "score")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; only a local session gets one of its own where none is named."""
    _checkpoint_folder(df)
    return df.checkpoint()


def _checkpoint_folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="citelake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``checkpointed`` for wide rows: a compressed columnar table in the checkpoint folder, of which later steps read the
    columns they need. The driver's JVM then collects its garbage, so the shuffles that led to it leave the disks."""
    path = f"{_checkpoint_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame):
    """Delete the table of ``stored`` rows that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("table-"):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hops(edges: DataFrame, source: int, limit: int) -> DataFrame:
    """(id, hop): length of the shortest path over undirected edges (a, b), up to limit."""
    spark = edges.sparkSession
    edges = edges.persist()
    seen = frontier = spark.createDataFrame([(source, 0)], "id bigint, hop int")
    for k in range(1, limit + 1):
        frontier = checkpointed(edges.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that every id of the undirected edges (a, b) reaches.

    Each round takes the least label around a node, then the label of that label, so long chains take few rounds. Only the
    links and the labels of two rounds are on disk at a time.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        now = labels.join(near, "id").select("id", F.least("component", "near").alias("c"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        now = stored(now.join(jump, "c", "left").select("id", F.least("c", "further").alias("component"), "before"))
        forget(labels)
        labels = now.drop("before")
        if now.where("component <> before").isEmpty():
            forget(both)
            return labels


def similar(edges: DataFrame, node: int, k: int, outgoing: bool = True) -> DataFrame:
    """(id, shared, jaccard): nodes that share references (outgoing) or citers with a node."""
    me, of = ("src", "dst") if outgoing else ("dst", "src")
    mine = edges.where(F.col(me) == node).select(of)
    size = edges.groupBy(me).agg(F.count("*").alias("size"))
    shared = edges.join(F.broadcast(mine), of).where(F.col(me) != node).groupBy(me).agg(F.count("*").alias("shared"))
    own = mine.agg(F.count("*").alias("own"))
    made = shared.join(size, me).join(F.broadcast(own)).select(F.col(me).alias("id"), "shared", (F.col("shared") / (F.col("own") + F.col("size") - F.col("shared"))).alias("jaccard"))
    return made.orderBy(F.desc("jaccard"), F.desc("shared"), "id").limit(k)


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of a partition of the undirected simple graph (a, b), both directions given."""
    a, b = members.select(F.col("id").alias("a"), F.col("grp").alias("ga")), members.select(F.col("id").alias("b"), F.col("grp").alias("gb"))
    tagged = edges.join(a, "a").join(b, "b")
    each = tagged.groupBy("ga").agg(F.count("*").alias("degree"), F.sum(F.when(F.col("ga") == F.col("gb"), 1).otherwise(0)).alias("inside"))
    both = each.agg(F.sum("degree").alias("m2"))
    return each.join(F.broadcast(both)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): synchronous label propagation over (a, b, weight), ties to the least label; ranked by size."""
    edges = edges.persist()
    labels = edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("best"))
        labels = checkpointed(best.select(F.col("a").alias("id"), (-F.col("best.l")).alias("label")))
    return by_size(labels, "label")


def by_size(labels: DataFrame, column: str) -> DataFrame:
    """(id, community): communities numbered from 0 by size, then least member. Only the sizes are gathered and ordered."""
    sizes = labels.groupBy(column).agg(F.count("*").alias("size"), F.min("id").alias("least"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.col("least").alias("l"))))
    places = sizes.agg(order.alias("all")).select(F.posexplode("all").alias("community", "x")).select("community", F.col("x.l").alias("least"))
    numbered = sizes.join(places, "least").select(column, "community")
    return labels.join(numbered, column).select("id", "community")


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 4, seed: int = 42) -> DataFrame:
    """(id, community): Louvain over undirected weighted edges (a, b, weight) in both directions, numbered by size.

    In a round every node sees the communities around it as they were before and half of the nodes, chosen by a hash of
    node and round, move to the one with the highest gain in modularity (ties to the least), if that beats staying. Half
    of them standing still is what keeps neighbours from swapping places. A level ends when the modularity no longer
    grows; its communities are the nodes of the next. Every round is one materialised table, so results are the same on
    every run.
    """
    graph = checkpointed(edges.groupBy("a", "b").agg(F.sum("weight").cast("double").alias("w")))
    m2 = graph.agg(F.sum("w")).first()[0] or 0.0
    whole = checkpointed(graph.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
    if not m2:
        return by_size(whole, "c")
    quality = None
    for level in range(levels):
        degree = checkpointed(graph.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        state = checkpointed(degree.withColumn("c", F.col("id")))
        best, still = _modularity(graph, state, m2, resolution), 0
        kept = state
        for turn in range(rounds):
            total = state.groupBy("c").agg(F.sum("k").alias("t"))
            around = graph.where("a <> b").join(state.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("e"))
            own = state.select("id", "k", F.col("c").alias("own"))
            seen = around.unionByName(state.select("id", "c", F.lit(0.0).alias("e"))).groupBy("id", "c").agg(F.sum("e").alias("e"))
            rest = F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("e") - resolution * F.col("k") * rest / m2, 9)
            rated = seen.join(own, "id").join(total, "c").withColumn("gain", gain)
            pick = F.min(F.struct((-F.col("gain")).alias("g"), "c"))["c"].alias("to")
            stay = F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay")
            moves = rated.groupBy("id", "k", "own").agg(pick, stay, F.max("gain").alias("top"))
            turned = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit(turn), "id"), F.lit(2)) == 0
            state = checkpointed(moves.select("id", "k", F.when(turned & (F.col("top") > F.col("stay")), F.col("to")).otherwise(F.col("own")).alias("c")))
            now = _modularity(graph, state, m2, resolution)
            if now > best + 1e-7:
                best, kept, still = now, state, 0
            elif (still := still + 1) == 2:
                break
        if quality is not None and best <= quality + 1e-7:
            break
        quality = best
        names = kept.select(F.col("id").alias("c"), F.col("c").alias("to"))
        whole = checkpointed(whole.join(names, "c").select("id", F.col("to").alias("c")))
        a, b = kept.select(F.col("id").alias("a"), F.col("c").alias("ca")), kept.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        graph = checkpointed(graph.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return by_size(whole, "c")


def communities(edges: DataFrame, resolution: float = 1.0, local_edges: int = 500_000, array_nodes: int = 40_000_000) -> DataFrame:
    """(id, community) by Louvain: nodes one after the other in a single task up to ``local_edges`` directed edges, which
    bounds what the task holds, else in rounds over all of them: over blocks of edges while the labels of all nodes fit
    arrays (20 bytes a node in each task), else over tables. All are the same on every run; they need not agree."""
    edges = checkpointed(edges)
    n = edges.count()
    if backend(n, limit=local_edges) == "distributed":
        nodes = checkpointed(edges.select(F.col("a").cast("bigint").alias("id")).distinct())
        return louvain_blocks(nodes, edges, n, resolution) if nodes.count() <= array_nodes else louvain(edges, resolution)
    rows = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("weight").cast("double").alias("weight"), F.lit(0).alias("all"))
    labels = rows.groupBy("all").applyInPandas(_one_by_one(resolution), "id bigint, label bigint")
    return by_size(checkpointed(labels), "label")


def _blocks(edges: DataFrame, n: int) -> DataFrame:
    """(a, b, w) as one row of three arrays for each part: all edges (a, b, w) of a node in one part, in order."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        order = np.lexsort((b, a))
        yield pa.record_batch({"a": [a[order].tobytes()], "b": [b[order].tobytes()], "w": [w[order].tobytes()]})

    parts = max(edges.sparkSession.sparkContext.defaultParallelism, n // 500_000 + 1)
    whole = edges.repartition(parts, "a").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return checkpointed(whole.mapInArrow(pack, "a binary, b binary, w binary"))


def _each_block(f, schema: str):
    """Apply f(a, b, w) -> dict of columns to every block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch(f(np.frombuffer(row["a"], "i8"), np.frombuffer(row["b"], "i8"), np.frombuffer(row["w"], "f8")))

    return lambda blocks: blocks.mapInArrow(run, schema)


def louvain_blocks(nodes: DataFrame, edges: DataFrame, n_edges: int, resolution: float = 1.0, rounds: int = 8, levels: int = 4, seed: int = 42) -> DataFrame:
    """(id, community): the rounds of ``louvain`` with the edges (a, b, weight) in blocks and the labels of nodes (id) in
    arrays, which go to all tasks. A round is one pass over the blocks, which also gives the modularity before it."""
    import numpy as np
    import pyarrow as pa

    sc = nodes.sparkSession.sparkContext
    ids = np.sort(nodes.toArrow().column("id").to_numpy())
    known = sc.broadcast(ids)

    def placed(batches):
        for t in batches:
            a, b = (np.searchsorted(known.value, t.column(c).to_numpy()) for c in ("a", "b"))
            yield pa.record_batch({"a": a, "b": b, "w": t.column("w")})

    rows = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
    blocks = _blocks(rows.mapInArrow(placed, "a bigint, b bigint, w double"), n_edges)
    whole, quality, n, m2 = np.arange(len(ids)), None, len(ids), 0.0
    for level in range(levels):
        label, total = np.arange(n), np.zeros(n)
        degrees = _each_block(lambda a, b, w: dict(zip(("i", "k"), ([x.tobytes()] for x in _sums(a, w)), strict=True)), "i binary, k binary")
        for r in degrees(blocks).toLocalIterator():
            total[np.frombuffer(r["i"], "i8")] = np.frombuffer(r["k"], "f8")
        degree, m2 = total, float(total.sum())
        if not m2:
            break
        best, kept, still = None, label, 0
        for turn in range(rounds + 1):
            total = np.bincount(label, degree, n)
            shared = sc.broadcast((label.astype("i4"), total))
            inside, moves = 0.0, []
            for r in _each_block(_moves(shared, m2, resolution, seed + 1000 * level + turn), "i binary, c binary, inside double")(blocks).collect():
                inside += r["inside"]
                moves.append((np.frombuffer(r["i"], "i8"), np.frombuffer(r["c"], "i8")))
            shared.destroy()
            now = inside / m2 - resolution * float(total @ total) / (m2 * m2)
            if best is None or now > best + 1e-7:
                best, kept, still = now, label, 0
            elif (still := still + 1) == 2:
                break
            label = label.copy()
            for i, c in moves:
                label[i] = c
        if quality is not None and best <= quality + 1e-7:
            break
        quality = best
        names, kept = np.unique(kept, return_inverse=True)
        whole = kept[whole]
        if len(names) == n:
            break
        shared, n = sc.broadcast(kept.astype("i4")), len(names)
        joined = _each_block(_joined(shared, n), "a bigint, b bigint, w double")(blocks)
        blocks = _blocks(joined, n_edges)
        shared.destroy()
    sizes, least = np.bincount(whole), np.unique(whole, return_index=True)[1]
    place = np.empty(len(sizes), "i4")
    place[np.lexsort((least, -sizes))] = np.arange(len(sizes))
    found = sc.broadcast(place[whole])

    def told(batches):
        for t in batches:
            yield pa.record_batch({"id": t.column("id"), "community": found.value[np.searchsorted(known.value, t.column("id").to_numpy())]})

    return nodes.mapInArrow(told, "id bigint, community int")


def _sums(key, w):
    """The distinct values of a sorted key and the sums of w."""
    import numpy as np

    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, "i8")
    return key[start], np.add.reduceat(w, start) if len(key) else np.zeros(0)


def _joined(shared, n: int):
    def run(a, b, w):
        import numpy as np

        key = shared.value[a].astype("i8") * n + shared.value[b]
        order = np.argsort(key, kind="stable")
        key, w = _sums(key[order], w[order])
        return {"a": key // n, "b": key % n, "w": w}

    return run


def _moves(shared, m2: float, resolution: float, seed: int):
    """Of one block: nodes that move and to where, and the weight inside communities as they are."""

    def run(a, b, w):
        import numpy as np

        label, total = shared.value
        n = len(label)
        if not len(a):
            return {"i": [b""], "c": [b""], "inside": [0.0]}
        nodes, k = _sums(a, w)
        near = label[b].astype("i8")
        inside = float(w[label[a] == near].sum())
        own = label[nodes].astype("i8")
        # every node also sees its own community, if without links
        key, e = np.r_[a * n + near, nodes * n + own], np.r_[np.where(a != b, w, 0.0), np.zeros(len(nodes))]
        order = np.argsort(key, kind="stable")
        key, e = _sums(key[order], e[order])
        at, to = np.searchsorted(nodes, key // n), key % n
        mine = to == own[at]
        gain = np.round(e - resolution * k[at] * (total[to] - np.where(mine, k[at], 0.0)) / m2, 9)
        start = np.searchsorted(at, np.arange(len(nodes)))
        top = np.maximum.reduceat(gain, start)
        pick = np.minimum.reduceat(np.where(gain == top[at], to, n), start)
        x = nodes.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xBF58476D1CE4E5B9 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        go = (((x >> np.uint64(31)) & np.uint64(1)) == 0) & (top > gain[mine])
        return {"i": [nodes[go].tobytes()], "c": [pick[go].tobytes()], "inside": [inside]}

    return run


def _one_by_one(resolution: float):
    def run(rows):
        import pandas as pd

        around: dict[int, dict[int, float]] = {}
        for a, b, w in zip(rows["a"].tolist(), rows["b"].tolist(), rows["weight"].tolist(), strict=True):
            own = around.setdefault(a, {})
            own[b] = own.get(b, 0.0) + w
        whole = {i: i for i in around}
        m2 = sum(sum(x.values()) for x in around.values())
        while m2:
            label = {i: i for i in around}
            degree = {i: sum(x.values()) for i, x in around.items()}
            total = dict(degree)
            moved, passes = True, 0
            while moved and passes < 50:
                moved, passes = False, passes + 1
                for i in sorted(around):
                    mine, k = label[i], degree[i]
                    links = {mine: 0.0}
                    for j, w in around[i].items():
                        if j != i:
                            links[label[j]] = links.get(label[j], 0.0) + w
                    total[mine] -= k
                    gain = {c: w - resolution * k * total[c] / m2 for c, w in links.items()}
                    best = min(gain, key=lambda c: (-round(gain[c], 9), c))
                    if round(gain[best] - gain[mine], 9) > 0:
                        label[i], moved = best, True
                    total[label[i]] += k
            whole = {i: label[c] for i, c in whole.items()}
            if all(i == c for i, c in label.items()):
                break
            merged: dict[int, dict[int, float]] = {}
            for i, x in around.items():
                own = merged.setdefault(label[i], {})
                for j, w in x.items():
                    own[label[j]] = own.get(label[j], 0.0) + w
            around = merged
        return pd.DataFrame({"id": list(whole), "label": list(whole.values())})

    return run


def _modularity(graph: DataFrame, state: DataFrame, m2: float, resolution: float) -> float:
    a, b = state.select(F.col("id").alias("a"), F.col("c").alias("ca")), state.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    inside = graph.join(a, "a").join(b, "b").where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / m2 - resolution * squares / (m2 * m2)


def backend(edges: int, asked: str = "auto", limit: int = 5_000_000) -> str:
    """``local`` (arrays in one task for each source) or ``distributed``, by the number of edges unless one is asked for."""
    if asked not in ("auto", "local", "distributed"):
        raise ValueError("backends are auto, local and distributed")
    return asked if asked != "auto" else "local" if edges <= limit else "distributed"


def sources(nodes: DataFrame, exact: int = 5000, sample: int = 500, seed: int = 42) -> list[int]:
    """All nodes of a graph of at most exact nodes, else a seeded sample."""
    chosen = nodes if nodes.count() <= exact else nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    return [r["id"] for r in chosen.select("id").collect()]


def betweenness(nodes: DataFrame, edges: DataFrame, sources: list[int] | None = None, parallel: int = 16, block_edges: int = 2_000_000, kept_edges: int = 4_000_000) -> DataFrame:
    """(id, score): shortest-path betweenness of the undirected graph (a, b), normalised, from the given sources, or exact:
    from all nodes, however many.

    Executors number the edges and sort them into blocks of about ``block_edges``; the driver hands blocks on one by one
    and holds the ids of nodes alone. Sources are dealt to tasks; each holds the blocks (4 bytes an edge direction) and runs
    one breadth-first pass and one accumulation per source, a block at a time; contributions are summed by an aggregation.
    A source takes time by the edges of its component alone. Edges of shortest paths, up to ``kept_edges`` of a source, are
    kept for the accumulation; those beyond are looked up again.
    """
    import numpy as np
    import pyarrow as pa

    spark = nodes.sparkSession
    sc = spark.sparkContext
    ids = np.sort(nodes.select(F.col("id").cast("bigint").alias("id")).toArrow().column(0).to_numpy())
    known = sc.broadcast(ids)
    edges = checkpointed(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    n, k, parts = len(ids), len(ids) if sources is None else len(sources), edges.count() // block_edges + 1
    width = n // parts + 1

    def placed(batches):
        for t in batches:
            a, b = (np.searchsorted(known.value, t.column(c).to_numpy()) for c in ("a", "b"))
            yield pa.record_batch({"part": a // width, "a": a % width, "b": b})

    def pack(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))
        part, a, b = (t.column(c).to_numpy() for c in ("part", "a", "b"))
        order = np.lexsort((b, a, part))
        part, a, b = part[order], a[order], b[order].astype("i4")
        for x in np.unique(part):
            i, j = np.searchsorted(part, [x, x + 1])
            start = np.searchsorted(a[i:j], np.arange(width + 1)).astype("i4")
            yield pa.record_batch({"part": [x], "start": [start.tobytes()], "b": [b[i:j].tobytes()]})

    blocks = edges.mapInArrow(placed, "part bigint, a bigint, b bigint").repartition(min(parts, 4 * sc.defaultParallelism + parts // 8), "part")
    shared = {}
    for r in checkpointed(blocks.mapInArrow(pack, "part bigint, start binary, b binary")).toLocalIterator():
        shared[r["part"]] = sc.broadcast((np.frombuffer(r["start"], "i4"), np.frombuffer(r["b"], "i4")))

    def run(batches):
        paths, depth, owed, total, turn = np.zeros(n), np.full(n, -1, "i4"), np.zeros(n), np.zeros(n), np.zeros(n, "i4")

        def ahead(frontier):
            """Edges (u, v) of a sorted frontier, block by block."""
            at = frontier // width
            for x in np.unique(at).tolist():
                if x in shared:
                    start, to = shared[x].value
                    i, j = np.searchsorted(at, [x, x + 1])
                    own = frontier[i:j] - x * width
                    size = start[own + 1] - start[own]
                    yield np.repeat(frontier[i:j], size), to[np.repeat(start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]

        for batch in batches:
            for s in batch.column(0).to_numpy():
                paths[s], depth[s] = 1, 0
                levels, kept, held = [np.array([s])], [], 0
                while len(levels[-1]):
                    d, fresh, own = len(levels), [], []
                    for u, v in ahead(levels[-1]):
                        at = depth[v]
                        new = v[at < 0]
                        depth[new] = d
                        # each new node once: where its last turn stands
                        turn[new] = np.arange(len(new), dtype="i4")
                        fresh.append(new[turn[new] == np.arange(len(new), dtype="i4")])
                        on = (at < 0) | (at == d)
                        u, v = u[on], v[on]
                        np.add.at(paths, v, paths[u])
                        held += len(u)
                        own.append((u, v))
                    kept.append(own if held <= kept_edges else None)
                    levels.append(np.sort(np.concatenate(fresh)) if fresh else np.zeros(0, "i4"))
                for d in range(len(levels) - 2, 0, -1):
                    for u, v in kept[d - 1] if kept[d - 1] is not None else ahead(levels[d - 1]):
                        if kept[d - 1] is None:
                            on = depth[v] == d
                            u, v = u[on], v[on]
                        np.add.at(owed, u, paths[u] / paths[v] * (1 + owed[v]))
                owed[s] = 0
                reached = np.concatenate(levels)
                total[reached] += owed[reached]
                paths[reached], depth[reached], owed[reached] = 0, -1, 0
        for i in range(0, n, 1 << 18):
            yield pa.record_batch({"id": known.value[i : i + (1 << 18)], "score": total[i : i + (1 << 18)]})

    scale = 1 / ((n - 1) * (n - 2)) * n / k if n > 2 and k else 0.0
    if sources is None:
        dealt = spark.range(0, n, 1, max(parallel, sc.defaultParallelism)).toDF("source")
    else:
        dealt = spark.createDataFrame([(int(s),) for s in np.searchsorted(ids, sources)], "source bigint").repartition(min(parallel, max(k, 1)))
    return dealt.mapInArrow(run, "id bigint, score double").groupBy("id").agg((F.sum("score") * scale).alias("score"))
