"""Graph algorithms on small graphs, and every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from citelake import catalog
from citelake.operators import algorithms as alg

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_pagerank_star(spark):
    nodes = spark.range(7).toDF("id")  # 0..4 cite 5, 5 cites 6
    got = {r["id"]: r["score"] for r in alg.pagerank(nodes, _edges(spark, [(i, 5) for i in range(5)] + [(5, 6)]), 60).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got[6] > got[5] > got[0] and abs(got[0] - got[4]) < 1e-12


def test_pagerank_converges_on_a_chain(spark):
    n = 30
    want = [1.0]  # 0 -> 1 -> ... -> 29: each score is what its citer gives and an equal share of the rest
    for _ in range(n - 1):
        want.append(1 + 0.85 * want[-1])
    want = [x / sum(want) for x in want]
    got = {r["id"]: r["score"] for r in alg.pagerank(spark.range(n).toDF("id"), _edges(spark, [(i, i + 1) for i in range(n - 1)]), 200, tolerance=1e-8).collect()}
    assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-6 and abs(sum(got.values()) - 1) < 1e-9
    assert "i01_pagerank_converged" in catalog.queries()


def test_betweenness_modularity_communities(spark):
    a, b = range(5), range(5, 10)
    pairs = [(x, y) for g in (a, b) for x in g for y in g if x != y] + [(0, 10), (10, 0), (10, 5), (5, 10)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    nodes = spark.range(11).toDF("id")
    got = {r["id"]: r["score"] for r in alg.betweenness(nodes, edges, list(range(11))).collect()}
    assert max(got, key=got.get) == 10 and abs(got[3]) < 1e-12 and abs(got[10] - 25 * 2 / (10 * 9)) < 1e-9
    members = nodes.select("id", (F.col("id").between(5, 9)).cast("int").alias("grp"))
    assert alg.modularity(edges, members).first()[0] > 0.3
    labels = {r["id"]: r["community"] for r in alg.label_propagation(edges.withColumn("weight", F.lit(1)), 8).collect()}
    assert len({labels[i] for i in range(1, 5)}) == 1 and labels[1] != labels[6]


def test_betweenness_takes_every_paper_of_a_small_graph(spark):
    from citelake.graph import from_orders
    from citelake.operators import read

    g = from_orders(spark, FOLDER)
    ids = [r["id"] for r in g.papers.select("id").collect()]
    want = {r["id"]: r["score"] for r in alg.betweenness(g.papers.select("id"), read.undirected(g.cites), ids).collect()}
    got = {r["id"]: r["score"] for r in catalog.queries()["i04_betweenness"](spark, FOLDER).collect()}
    assert len(ids) <= 5000 and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    many = spark.range(5001).toDF("id")
    assert len(alg.sources(many)) == 500 and alg.sources(many) == alg.sources(many)


def test_louvain_and_components(spark):
    pairs = [(x, y) for g in (range(6), range(6, 12), range(12, 18)) for x in g for y in g if x != y] + [(0, 6), (6, 0), (7, 12), (12, 7)]
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "a bigint, b bigint, weight double")
    near, far = ({r["id"]: r["community"] for r in df.collect()} for df in (alg.communities(edges), alg.communities(edges, local_edges=0)))
    for got in (near, far):
        members = spark.createDataFrame(list(got.items()), "id bigint, grp int")
        assert len(set(got.values())) == 3 and alg.modularity(edges, members).first()[0] > 0.55
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a bigint, b bigint")
    assert {r["id"]: r["component"] for r in alg.connected(chain).collect()} == {i: 0 for i in range(21)} | {40: 40, 50: 40}


def test_paths_and_their_sentence(spark):
    from citelake.operators import usecases

    edges = spark.createDataFrame([("paper:1", "paper:2", "CITES"), ("author:9", "paper:2", "WROTE"), ("author:9", "paper:3", "WROTE"), ("paper:8", "paper:7", "CITES")], "src string, dst string, type string")
    path = usecases.shortest_path(edges, "paper:1", "paper:3")
    assert [(r["src"], r["dst"]) for r in path.orderBy("step").collect()] == [("paper:1", "paper:2"), ("author:9", "paper:2"), ("author:9", "paper:3")]
    names = spark.createDataFrame([("paper:1", "One"), ("author:9", "Nine")], "id string, name string")
    assert usecases.describe(path, names).first()[0] == "One cites paper:2; Nine wrote paper:2; Nine wrote paper:3"
    assert usecases.shortest_path(edges, "paper:1", "paper:7").count() == 0 and usecases.shortest_path(edges, "paper:1", "paper:3", 2).count() == 0


@pytest.mark.parametrize("key", sorted(k for k in catalog.queries() if k not in catalog.oracle_sql() and k not in ("k08_analytics_run", "i04_betweenness")))
def test_queries_without_sql_run(spark, key):
    assert catalog.queries()[key](spark, FOLDER).count() > 0


def test_recommendations(spark):
    from citelake.graph import from_orders
    from citelake.operators import usecases

    g = from_orders(spark, FOLDER)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "id bigint, vector array<float>")
    rows, note = usecases.recommend(g, vectors, [33, 34], 15, iterations=5, tolerance=None)
    rows = rows.collect()
    assert note is None and rows and not {33, 34} & {r["id"] for r in rows} and all(r["reasons"] for r in rows)
    with pytest.raises(KeyError):
        usecases.recommend(g, vectors, [33, -5], 5)


def test_similar(spark):
    edges = _edges(spark, [(1, 11), (1, 12), (1, 13), (2, 11), (2, 12), (3, 19)])
    assert [(r["id"], r["shared"], round(r["jaccard"], 6)) for r in alg.similar(edges, 1, 5).collect()] == [(2, 2, 0.666667)]


def test_clean_html_reads_whole_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r["page_id"]: r["clean"] for r in catalog.queries()["j01_clean_html"](spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for r in pages:
        want = None if r["html"] is None else re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(r["html"]))).strip() or None
        assert got[r["page_id"]] == want


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, key):
    df = catalog.queries()[key](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[key])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(_norm(r[i]) for i in place) for r in want.fetchall())
