"""What operators make on the way: rows in proportion to their input where many rows share a key, on small tables."""

import numpy as np
from pyspark.sql import functions as F

from citelake.operators import algorithms as alg
from citelake.operators import ingest, resolve, search


def most_rows(df) -> int:
    """The rows that the largest step of a plan made, as its metrics say after a run."""
    df.write.format("noop").mode("overwrite").save()
    df = df.select("*")
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return most


def hot(spark, n: int):
    """n rows under one DOI and under one of two OpenAlex ids."""
    return spark.range(1, n + 1).select("id", (F.col("id") % 2 == 1).alias("is_stub"), F.lit("10.1/a").alias("doi"), (F.col("id") % 2).cast("string").alias("openalex_id"))


def test_lists_of_a_class_and_missing_identifiers(spark):
    """as in SQL, a node is in neither list where a missing identifier leaves open whether it differs."""
    rows = spark.createDataFrame([(1, False, "a", "x"), (2, False, "a", None), (3, False, "a", "y"), (4, False, "a", "x"), (5, False, "b", None)], "id bigint, is_stub boolean, doi string, openalex_id string")
    kinds = ("doi", "openalex_id")
    got = {r["record"]: (r["node"], r["merge_ids"], r["conflicts"]) for r in resolve.match_identifiers(rows, rows, kinds, strict=True).collect()}
    assert got == dict.fromkeys((1, 2, 3, 4), (1, [4], [3])) | {5: (5, [], [])}
    loose = {r["record"]: r["merge_ids"] for r in resolve.match_identifiers(rows, rows, kinds).collect()}
    assert loose[1] == [2, 4]


def test_merges_are_made_of_classes(spark):
    """rows that agree in all identifiers meet as one class."""
    rows = hot(spark, 400)
    made = resolve.match_identifiers(rows, rows, ("doi", "openalex_id"))
    assert most_rows(made) <= 4 * 400
    assert {(r["node"], len(r["merge_ids"]), len(r["conflicts"])) for r in made.collect()} == {(2, 199, 200)}


def test_first_node_of_an_identifier(spark):
    """the first node of each identifier is found before records meet it."""
    rows = hot(spark, 400)
    made = ingest.identifier_matches(rows, rows, ("doi", "openalex_id"))
    assert most_rows(made) <= 4 * 400
    assert {(r["node"], r["rank"]) for r in made.collect()} == {(2, 0)}


def test_pairs_are_made_once(spark):
    """a pair that shares two identifiers is made by the first; ids of several rows still give each pair once."""
    rows = hot(spark, 100)
    made = resolve.candidates(rows, rows, ("doi", "openalex_id"))
    assert most_rows(made) == made.count() == 100 * 100
    twice = rows.unionByName(rows.where("id < 3").withColumn("doi", F.lit("10.1/b")))
    assert resolve.candidates(twice, twice, ("doi", "openalex_id")).count() == 100 * 100


def test_louvain_over_blocks(spark):
    """rounds over blocks of edges find communities nearly as good as one node after the other."""
    n = 600
    pairs = spark.range(6 * n).select((F.col("id") % n).alias("a"), F.pmod(F.xxhash64("id"), F.lit(30)).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(6)) == 0).alias("far"))
    pairs = pairs.select("a", F.when(F.col("far"), F.pmod(F.xxhash64("a", "x"), F.lit(n))).otherwise(F.floor(F.col("a") / 30) * 30 + F.col("x")).alias("b")).where("a <> b")
    edges = pairs.union(pairs.select("b", "a")).distinct().withColumn("weight", F.lit(1.0)).localCheckpoint()
    near, far = (alg.communities(edges).localCheckpoint(), alg.communities(edges, local_edges=0).localCheckpoint())
    good = [alg.modularity(edges.select("a", "b"), df.withColumnRenamed("community", "grp")).first()[0] for df in (near, far)]
    assert far.count() == near.count() and good[1] > 0.9 * good[0]
    nodes = edges.select(F.col("a").alias("id")).distinct()
    assert sorted(alg.louvain_blocks(nodes, edges, edges.count()).collect()) == sorted(far.collect())


def test_titles_are_compared_once(spark):
    """rows of one title meet by a common author, not all with all."""
    rows = spark.range(1, 401).select("id", F.lit(False).alias("is_stub"), F.lit("deep rivers of the north coast").alias("title_key"), F.lit(2001).alias("year"), F.lit("Deep").alias("title"), F.array(F.floor(F.col("id") / 2).cast("string")).alias("authors"))
    made = resolve.fuzzy_matches(rows, rows)
    assert most_rows(made) <= 4 * 400
    assert {(r["record"], r["node"]) for r in made.collect()} == {(i, i + 1 if i % 2 == 0 else i - 1) for i in range(2, 400)}


def test_a_batch_compares_near_titles_alone(monkeypatch):
    """records of one block are looked up, not compared with all that are kept."""
    asked = []
    monkeypatch.setattr(resolve.nz, "similarity", lambda x, y, f=resolve.nz.similarity: asked.append(1) or f(x, y))
    rule = resolve._Greedy(("doi",))
    rows = [{"id": i, "title_key": f"a title of the year {i % 4}", "year": 2000, "authors": [str(i // 8)], "doi": None} for i in range(400)]
    assert [rule.add(r) for r in rows] == [i // 8 * 8 for i in range(400)] and len(asked) <= 16


def test_blocks_share_a_stream(spark):
    """F8: records without a partner stay in the JVM, the others go through Python as one stream and not block by block."""
    kinds = ("doi",)
    rows = spark.range(60).select("id", F.col("id").alias("place"), F.lit(None).cast("string").alias("title_key"), F.lit(2000).alias("year"), F.array().cast("array<string>").alias("authors"), F.when(F.col("id") < 40, (F.col("id") % 20).cast("string")).alias("doi"))
    made = resolve.dedupe_batch(rows, kinds)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    assert {r["id"]: r["keep"] for r in made.collect()} == {i: i % 20 if i < 40 else i for i in range(60)}


def test_nodes_of_one_class_meet_an_author_once(spark):
    """nodes of one name that agree in identifiers and co-authors are asked once."""
    none = F.lit(None).cast("string")
    nodes = spark.range(200).select("id", F.lit("lee").alias("name_key"), none.alias("orcid"), none.alias("openalex_id"), F.array(F.lit("max"), F.lit("ned")).alias("coauthors"))
    asked = spark.range(200).select("id", none.alias("key"), none.alias("orcid"), none.alias("openalex_id"), F.lit("lee").alias("name_key"), F.array(F.lit("lee"), F.lit("max")).alias("coauthors"))
    made = resolve.resolve_authors(asked, nodes)
    assert most_rows(made) <= 1000 and {(r["node"], r["reason"]) for r in made.collect()} == {(0, "name+coauthor")}


def test_the_driver_gets_blocks_of_edges(spark, monkeypatch):
    """edges never come to the driver as one table; blocks of any size give the scores of brute force."""
    asked, real = [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: asked.append(df.columns) or real(df))
    links = {(i, (i * 7 + 3) % 40) for i in range(36)} | {(i, i + 1) for i in range(0, 30, 2)}
    links = {(a, b) for a, b in links | {(b, a) for a, b in links} if a != b}
    around = {i: [b for a, b in links if a == i] for i in range(42)}
    want = dict.fromkeys(range(42), 0.0)
    for s in range(42):
        depth, paths, turn, owed = {s: 0}, {s: 1}, [s], dict.fromkeys(range(42), 0.0)
        for u in turn:
            for v in around[u]:
                if v not in depth:
                    depth[v], paths[v] = depth[u] + 1, 0
                    turn.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
        for v in reversed(turn[1:]):
            for u in around[v]:
                if depth[u] == depth[v] - 1:
                    owed[u] += paths[u] / paths[v] * (1 + owed[v])
            want[v] += owed[v] / (41 * 40)
    edges = spark.createDataFrame(sorted(links), "a bigint, b bigint")
    for size in (10, 1000):
        got = {r["id"]: r["score"] for r in alg.betweenness(spark.range(42), edges, list(range(42)), 3, size).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert all(c == ["id"] for c in asked)


def test_a_step_of_pagerank_is_told_once(spark, monkeypatch):
    """the dangling sum and what moved are told by one pass over the scores."""
    asked, real = [], type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: asked.append(1) or real(df))
    edges, before = spark.createDataFrame([(i, (i * 3 + 1) % 12) for i in range(9)], "src bigint, dst bigint"), spark.conf.get("spark.sql.shuffle.partitions")
    scores = alg.pagerank(spark.range(12), edges, 6, tolerance=1e-30)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert len(asked) == 6 and abs(sum(r["score"] for r in scores.collect()) - 1) < 1e-9


def test_papers_are_grouped_once_for_authors(spark):
    """names of a paper are gathered once and read by both sides, not made from the order lines for each."""
    from citelake import catalog

    made = catalog.queries()["j17_resolve_author"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pools_of_hybrid_search_are_made_once(spark, monkeypatch):
    """a text without words has no direction and is near to none; what is fused are two small tables, and no broadcast
    waits for a pass over all texts."""
    monkeypatch.setattr(search, "WORDS_KEPT", 3)
    texts = ["the cat with the hat", "With a cat", "", None, "a Hat; the Hat, the HAT 42 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    vectors = search.embed(docs)
    assert {r["id"]: r["vector"] for r in vectors.collect()} == {i: list(map(float, np.float32(search.hash_vector(t or "")))) for i, t in enumerate(texts)}
    made, note = search.hybrid(docs, vectors, "the cat")
    plan = made._jdf.queryExecution().toString()
    assert note is None and "MapIn" not in plan and "InMemoryRelation" not in plan and made.first()["id"] == 0
    assert {r["id"] for r in search.knn(vectors, search.hash_vector("the cat"), 9).collect()} == {0, 1, 4}
    assert search.knn(vectors, search.hash_vector("-"), 9).isEmpty()
    assert "broadcast" not in search.bm25(docs, "the cat", 3)._jdf.queryExecution().toString().lower()


def test_training_gives_memory_back(spark, monkeypatch):
    """Pipeline: what the fit took on the driver is freed before the next stage."""
    from citelake.llm import toxicity

    asked = []
    monkeypatch.setattr(toxicity, "give_back", lambda: asked.append(1), raising=False)
    docs = spark.createDataFrame([(i, f"word {'bad' if i % 2 else 'good'} {i}") for i in range(20)], "doc_id bigint, text string")
    toxicity.train(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    assert asked


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """Pipeline: the fit runs in a task, the driver holds neither the terms of its sample nor what it takes."""
    from citelake.llm import toxicity

    asked = []
    monkeypatch.setattr(toxicity, "_fit", lambda slot, at, y, size: asked.append(1) or (0.0, np.zeros((size, 1 + toxicity.FACTORS), np.float32)))
    docs = spark.createDataFrame([(i, f"word {'bad' if i % 2 else 'good'} {i}") for i in range(20)], "doc_id bigint, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    assert not asked and model.params.any() and model.params.shape == ((model.slot >= 0).sum(), 1 + toxicity.FACTORS)


def test_garbage_goes_between_rounds(spark, monkeypatch):
    """Pipeline: the driver's JVM drops what a round of components has left before the next, and the heap stays small."""
    from citelake.llm import components as stars

    asked = []
    monkeypatch.setattr(stars, "collected", lambda df: asked.append(1) or df, raising=False)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "x bigint, y bigint")
    got = {r["id"]: r["component"] for r in stars.components(links, "x", "y").collect()}
    assert len(asked) > 1 and got == dict.fromkeys(range(10), 0)


def _bytes_written(rows, folder):
    rows.write.parquet(str(folder))
    return sum(f.stat().st_size for f in folder.iterdir() if f.suffix == ".parquet")


def test_pairs_are_written_in_a_fraction_of_a_byte(spark, tmp_path):
    rows = spark.range(6000).select("id", (F.col("id") % 30).cast("string").alias("doi"), (F.col("id") % 20).cast("string").alias("openalex_id"))
    pairs = resolve.candidates(rows, rows, ("doi", "openalex_id"))
    n = 30 * 200**2 + 20 * 300**2 - 60 * 100**2
    assert _bytes_written(pairs, tmp_path / "pairs") < 0.5 * n
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.count() == n == got.distinct().count()
    assert got.where("(record - node) % 30 <> 0 AND (record - node) % 20 <> 0").isEmpty()


def test_pairs_of_ids_in_slices_and_of_several_rows(spark):
    one = spark.range(2500).select("id", F.lit("x").alias("doi"), F.lit(None).cast("string").alias("openalex_id"))
    two = spark.createDataFrame([(7, "x", "o"), (7, None, "o"), (8, None, None), (9, None, "o")], "id bigint, doi string, openalex_id string")
    got = resolve.candidates(one, two, ("doi", "openalex_id"))
    assert got.count() == 2500 == got.distinct().count() and {r["node"] for r in got.select("node").distinct().collect()} == {7}
    both = sorted(tuple(r) for r in resolve.candidates(two, two, ("doi", "openalex_id")).collect())
    assert both == [(7, 7), (7, 9), (9, 7), (9, 9)]


def test_lists_of_classes_are_dealt_by_their_bytes(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 40).cast("string").alias("doi"), F.lit(False).alias("is_stub"))
    lists = resolve.match_classes(rows, rows, ("doi",), strict=True).select("ids", "node", F.array_join(F.col("merge_ids").cast("array<string>"), ",").alias("merges"))
    total = sum(100 * len(r["merges"]) for r in lists.select("merges").collect())
    parts = resolve.written_parts(rows, lists, ("merges",), ("doi",), each=total // 30)
    assert 30 <= parts <= 31
    made = resolve.of_classes(rows, lists, ("doi",), parts)
    held = made.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("merges").alias("lists"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in held) == 4000 and len(held) > 10 and max(r["lists"] for r in held) < 8 and all(r["n"] == 100 * r["lists"] for r in held)


def test_betweenness_of_a_large_graph_is_exact(spark, tmp_path):
    """One paper that 5099 others cite lies on all their paths; a sample of sources would give n / (n - 1) at most."""
    from citelake import catalog

    for t in ("part", "supplier", "nation", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    n = 5100
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), F.date_add(F.lit("1992-01-01").cast("date"), F.col("id").cast("int")).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit(1).cast("bigint").alias("o_custkey"))
    line = lambda order, i: i.select(order.alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    line(F.lit(0).cast("bigint"), spark.range(1, n)).unionByName(line(F.col("id"), spark.range(1, n))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r["score"] for r in catalog.queries()["i04_betweenness"](spark, str(tmp_path)).collect()}
    assert len(got) == n and abs(got[0] - 1) < 1e-12 and max(got[i] for i in range(1, n)) == 0


def test_betweenness_looks_edges_up_again(spark):
    g = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in g.integers(0, 60, (150, 2)) if a != b}
    edges = spark.createDataFrame(sorted(pairs | {(b, a) for a, b in pairs}), "a bigint, b bigint")
    nodes = spark.range(65).toDF("id")
    one, two, three = ({r["id"]: r["score"] for r in df.collect()} for df in (alg.betweenness(nodes, edges), alg.betweenness(nodes, edges, kept_edges=20, block_edges=50), alg.betweenness(nodes, edges, list(range(65)))))
    assert one.keys() == two.keys() == three.keys() and all(abs(one[i] - two[i]) < 1e-12 and abs(one[i] - three[i]) < 1e-12 for i in one)
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want = dict.fromkeys(range(65), 0.0)
    for s in range(65):  # by hand: Brandes
        order, paths, depth = [s], {s: 1}, {s: 0}
        for u in order:
            for v in around.get(u, ()):
                if v not in depth:
                    depth[v] = depth[u] + 1
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] = paths.get(v, 0) + paths[u]
        owed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in around.get(v, ()):
                if depth[u] == depth[v] - 1:
                    owed[u] += paths[u] / paths[v] * (1 + owed[v])
            want[v] += owed[v] if v != s else 0
    assert all(abs(one[i] - want[i] / (64 * 63)) < 1e-12 for i in want)


def _on_disk(spark) -> int:
    from pathlib import Path

    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return sum(f.stat().st_size for f in Path(folder.get().removeprefix("file:")).rglob("*") if f.is_file()) if folder.isDefined() else 0


def test_rounds_of_components_leave_the_disk(spark):
    before = _on_disk(spark)
    chain = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = alg.connected(chain.where("a % 50 <> 49"))
    assert got.where("component <> id - id % 50").isEmpty() and got.count() == 20_000
    assert _on_disk(spark) - before < 500_000


def test_a_batch_leaves_its_tables_alone_on_disk(spark):
    from citelake.operators import load

    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sha2(F.concat("id", i).cast("string").cast("binary"), 256)))
    made = spark.range(200).select("id", F.col("id").alias("place"), F.concat(F.lit("10.1/"), F.col("id")).alias("doi"), text.alias("abstract"))
    rows = spark.createDataFrame([], load.RECORD).unionByName(made, allowMissingColumns=True)
    before = _on_disk(spark)
    done = load.load_batch(load.empty(spark), rows)
    assert done.counts["received"] == done.counts["papers_created"] == done.tables["paper"].count() == 200
    assert done.tables["paper"].select("abstract").distinct().count() == 200
    assert _on_disk(spark) - before < 200 * 12_800
