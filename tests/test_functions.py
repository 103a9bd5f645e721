"""Hand-computed cases of the normalisers, the query parser, the guard, the limiter and the metrics."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from citelake.functions import normalize as nz
from citelake.functions import sql_guard
from citelake.operators import evaluate, ingest, search
from citelake.streaming.limiter import admitted, decide


def _map(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (nz.doi, {" HTTPS://doi.org/10.5555/Ab.C-9 ": "10.5555/ab.c-9", "DOI:10.1234567/x(y)": "10.1234567/x(y)", "10.12/short": None, "10.5555/": None, "see 10.5555/ab": None}),
        (nz.arxiv_id, {"2311.00417": "2311.00417", " https://arxiv.org/abs/0912.1234v12/ ": "0912.1234", "math.AG/0411222v3": "math.ag/0411222", "2311.004170": None, "2311.00417v2.pdf": None, "10.48550/x.2311.00417y": None}),
        (nz.orcid, {"0000-0001-5109-3700": "0000-0001-5109-3700", "orcid.org/0000-0002-9079-593x ": "0000-0002-9079-593X", "0000-0001-5109-3700/works": None}),
        (nz.title_key, {"Ünïted <b>Graphs</b> &amp; trees: a (short) tour!": "united graphs trees a short tour"}),
        (nz.clean_text, {"\t1 &amp; 2 <i>or</i>&nbsp;3 ": "1 & 2 or 3", "<p> </p>": None}),
        (nz.author_key, {"Zoë Q. Łuk-Novák": "z novak", "Plato": "plato"}),
        (nz.name_key, {"Máire Ní Bhriain-Ó'Dea &amp; Co": "maire ni bhriain o dea co"}),
        (nz.plain_slug, {"Señor Ångström": "senor-angstrom"}),
    ],
)
def test_normalisers(spark, f, cases):
    assert _map(spark, f, list(cases)) == list(cases.values())


def test_abstract_overlap_similarity(spark):
    row = spark.sql("SELECT map('sea', array(1, 4), 'the', array(0, 3), 'and', array(2)) AS m, array('a', 'b') AS a, array('b', 'c', 'd') AS b, 'kitten' AS s, 'sitting' AS t").select(
        nz.rebuild_abstract(F.col("m")), nz.author_overlap(F.col("a"), F.col("b")), nz.title_similarity(F.col("s"), F.col("t"))
    ).first()
    assert row[0] == "the sea and the sea" and row[1] == 0.5 and abs(row[2] - 8 / 13) < 1e-12


def test_query_parser():
    assert search.parse_query("graph neural") == [("graph", False), ("neural", True)]
    assert search.parse_query("a") is None and search.parse_query(" ") is None and search.parse_query("AND") is None


def test_hash_vectors():
    v = search.hash_vector("Graph neural networks")
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == search.hash_vector("graph NEURAL networks") and not any(search.hash_vector(""))


def test_fusion(spark):
    lists = {n: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, rank int") for n, ids in (("keyword", "abc"), ("semantic", "cad"))}
    got = {r["id"]: r["score"] for r in search.fuse(lists).collect()}
    assert sorted(got, key=lambda i: (-got[i], i))[:2] == ["a", "c"] and abs(got["a"] - (1 / 61 + 1 / 62)) < 1e-12


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("xayb")], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", x) for x in "abc"], "query string, item string")
    at2, at4 = (evaluate.retrieval(ranked, relevant, k).first() for k in (2, 4))
    from math import log2

    assert abs(at2["recall"] - 1 / 3) < 1e-12 and at4["reciprocal_rank"] == 0.5
    assert abs(at4["ndcg"] - (1 / log2(3) + 1 / log2(5)) / (1 + 1 / log2(3) + 0.5)) < 1e-12


def test_limiter(spark):
    assert decide(deque(), [0, 1, 2, 3, 61], 2, 60) == [True, True, False, False, True]
    events = spark.sql("SELECT 1L AS client, id, timestamp_seconds(id) AS ts FROM VALUES (0L), (1L), (2L), (61L) t(id)")
    assert [r["admitted"] for r in admitted(events, 2, 60).orderBy("id").collect()] == [True, True, False, True]


@pytest.mark.parametrize("bad", ["DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "SELECT x FROM t LIMIT 5000", "SELECT x FROM other", "SELECT y FROM t", "SELECT x FROM t -- c", "SELECT /* c */ x FROM t", "EXPLAIN SELECT x FROM t", "", "SET a=b", "CACHE TABLE t"])
def test_guard_rejects(spark, bad):
    spark.range(3).toDF("x").createOrReplaceTempView("t")
    with pytest.raises(sql_guard.Rejected):
        sql_guard.validate(spark, bad, {"t"})


def test_guard_accepts(spark):
    spark.range(3).toDF("x").createOrReplaceTempView("t")
    assert sql_guard.validate(spark, "SELECT x FROM t WHERE x = 'DROP'", {"t"}).endswith("LIMIT 50")


def test_upsert_merge_violations(spark):
    old = spark.createDataFrame([(1, "a", None, True)], "id int, title string, abstract string, ok boolean")
    new = spark.createDataFrame([(1, "b", "x", False), (2, "c", None, False)], "id int, title string, abstract string, ok boolean")
    got = {r["id"]: (r["title"], r["abstract"], r["ok"]) for r in ingest.upsert(old, new, "id", first=("title",), last=("abstract",), any_true=("ok",)).collect()}
    assert got == {1: ("a", "x", True), 2: ("c", None, False)}
    again = ingest.upsert(old, new, "id", first=("title",), last=("abstract",), any_true=("ok",))
    assert {tuple(r) for r in ingest.upsert(again, new, "id", first=("title",), last=("abstract",), any_true=("ok",)).collect()} == {tuple(r) for r in again.collect()}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    merges = spark.createDataFrame([(2, 1)], "old int, kept int")
    assert {tuple(r) for r in ingest.merge_nodes(edges, merges).collect()} == {(1, 3), (3, 1)}
    assert [r["n"] for r in ingest.violations(spark.createDataFrame([(1,), (1,), (2,)], "id int"), ["id"]).collect()] == [2]


def test_metrics_without_relevant_items(spark):
    ranked = spark.createDataFrame([("q", "x", 1)], "query string, item string, rank int")
    none = spark.createDataFrame([], "query string, item string")
    row = evaluate.retrieval(ranked, none, 5).first()
    assert (row["recall"], row["hit"], row["reciprocal_rank"], row["ndcg"]) == (1.0, 0, 0.0, 1.0)


def test_upsert_folds_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id int, first string, last string")
    new = spark.createDataFrame([(1, "b", "y", 1), (1, "c", "z", 2), (2, None, "u", 1), (2, "d", None, 2)], "id int, first string, last string, at int")
    got = {tuple(r) for r in ingest.upsert(old, new, "id", first=("first",), last=("last",), order="at").collect()}
    assert got == {(1, "a", "z"), (2, "d", "u")}


def test_trend_labels(spark):
    from citelake.operators import read

    years = [(t, y, n) for t, own in {"new": {2022: 2}, "up": {2018: 1, 2022: 9}, "down": {2018: 9, 2022: 1}, "even": {2018: 3, 2022: 4}, "once": {2022: 1}}.items() for y, n in own.items()]
    totals = spark.createDataFrame([(y, 20) for y in range(2017, 2023)], "year int, papers bigint")
    got = {r["topic_id"]: r for r in read.trends(spark.createDataFrame(years, "topic_id string, year int, papers bigint"), totals).collect()}
    assert {k: r["label"] for k, r in got.items()} == {"new": "emerging", "up": "rising", "down": "declining", "even": "steady"}
    assert abs(got["up"]["growth"] - 9.5 / 1.5) < 1e-12 and list(got)[0] == "new" and got["down"]["share_previous"] == 0.15


def test_resolution(spark):
    from citelake.operators import resolve

    ids = "doi string, openalex_id string, arxiv_id string, s2_id string, seed_key string"
    paper = f"id bigint, {ids}, title_key string, year int, authors array<string>, is_stub boolean"
    nodes = spark.createDataFrame([
        (1, "10.1/a", "W1", None, None, None, "deep rivers of the north coast", 2001, ["a bee"], False), (2, None, None, "2001.00001", None, None, None, None, None, True),
        (3, "10.1/z", None, None, None, "s3", "another matter entirely", 1999, ["c dee"], False),
    ], paper)
    records = spark.createDataFrame([
        (10, "10.1/a", None, "2001.00001", None, None, "x", None, None, None), (11, "10.1/a", None, None, None, "s3", "x", None, None, None),
        (12, None, None, None, None, None, "deep rivers of the north coasts", 2002, ["a bee", "e eff"], None), (13, None, None, None, None, None, "deep rivers of the north coasts", 2009, ["a bee"], None),
        (14, "10.9/q", None, None, None, None, "deep rivers of the north coast", 2001, ["a bee"], None), (15, None, None, None, None, None, "another matter entirely", 1999, None, None),
    ], paper)
    by_id = {r["record"]: (r["node"], r["reason"], r["merge_ids"], r["conflicts"]) for r in resolve.match_identifiers(records, nodes).collect()}
    assert by_id == {10: (1, "doi", [2], []), 11: (1, "doi", [], [3])}
    got = {r["record"]: (r["node"], r["reason"]) for r in resolve.resolve(records, nodes).collect()}
    assert got == {10: (1, "doi"), 11: (1, "doi"), 12: (1, "title+year+authors"), 13: (None, "new"), 14: (None, "new"), 15: (3, "title+year+authors")}


def test_dedupe_and_merge_of_a_batch(spark):
    from citelake.operators import resolve

    ids = "doi string, openalex_id string, arxiv_id string, s2_id string, seed_key string"
    rows = [(1, 0, "d1", None, None, None, None, "north", 2001, ["a"]), (2, 1, None, "W1", None, None, None, "south", 2001, ["b"]), (3, 2, "d1", "W1", None, None, None, "third", None, None), (4, 3, None, None, None, None, None, "south", 2002, ["b"]), (5, 4, None, None, None, None, None, "south", 2010, ["b"])]
    records = spark.createDataFrame(rows, f"id bigint, place bigint, {ids}, title_key string, year int, authors array<string>")
    assert {r["id"]: r["keep"] for r in resolve.dedupe_batch(records).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
    lists = spark.createDataFrame([("k", 1, None, ["x"], ["Tea", "ink"]), ("k", 0, "first", ["y", "z"], ["tea"]), ("k", 2, "late", ["u", "v"], None)], "key string, o int, t string, authors array<string>, words array<string>")
    row = resolve.merge_records(lists, "key", "o", ("t",), ("words",)).first()
    assert (row["t"], row["authors"], row["words"], row["merged"]) == ("first", ["y", "z"], ["tea", "ink"], 3)


def test_authors(spark):
    from citelake.operators import resolve

    fields = "id string, key string, orcid string, openalex_id string, name_key string, coauthors array<string>"
    nodes = spark.createDataFrame([("author:k", None, None, None, "kay", []), ("n1", None, "o1", None, "lee", ["max", "ned"]), ("n2", None, None, None, "lee", ["max"]), ("n3", None, "o3", None, "pat", ["max"])], fields).drop("key")
    asked = spark.createDataFrame([("a", "k", None, None, "x", []), ("b", None, "o1", None, "y", []), ("c", None, None, None, "lee", ["max", "lee"]), ("d", None, "o9", None, "pat", ["max"]), ("e", None, None, None, "lee", ["lee"])], fields)
    got = {r["author"]: (r["node"], r["reason"]) for r in resolve.resolve_authors(asked, nodes).collect()}
    assert got == {"a": ("author:k", "key"), "b": ("n1", "orcid"), "c": ("n1", "name+coauthor"), "d": (None, "new"), "e": (None, "new")}
    mentions = spark.createDataFrame([(1, 1, "lee", ["lee", "max"]), (2, 2, "lee", ["lee", "max", "ned"]), (3, 3, "lee", ["lee", "ned"]), (4, 4, "lee", ["lee"]), (5, 5, "max", ["lee", "max"])], "id bigint, paper bigint, name_key string, coauthors array<string>")
    assert {r["id"]: r["author"] for r in resolve.cluster_mentions(mentions).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_assistants(spark):
    import json

    from citelake.operators import assist

    spark.range(7).selectExpr("id AS x", "repeat('y', 400) AS t").createOrReplaceTempView("t")
    good = json.dumps({"can_answer": True, "sql": "SELECT x, t FROM t ORDER BY x LIMIT 3"})
    out = assist.ask_query(spark, assist.Scripted([json.dumps({"can_answer": True, "sql": "DROP TABLE t"}), f"```json\n{good}\n```"]), "which?", {"t"})
    assert (out["attempts"], [r["x"] for r in out["rows"]], out["truncated"], len(out["rows"][0]["t"]), out["error"]) == (2, [0, 1, 2], True, 300, None)
    assert assist.ask_query(spark, assist.Scripted([json.dumps({"can_answer": False})]), "why?", {"t"})["error"]
    numbered = spark.createDataFrame([(1, 5, "A", "about a"), (2, 6, "B", "about b")], "number int, id int, title string, excerpt string")
    links = spark.createDataFrame([(1, 2)], "a int, b int")
    said = assist.answer(assist.Scripted([json.dumps({"answer": "So it is [1, 7] and [2].", "answerable": True})]), "q", numbered, links)
    assert (said["answer"], said["citations"], said["dropped"], said["grounded"]) == ("So it is [1] and [2].", [1, 2], [7], False)
    silent = assist.Scripted([])
    assert not assist.answer(silent, "q", numbered.limit(0), links)["grounded"] and not silent.asked
    with pytest.raises(assist.ProviderError):
        assist.Retrying(lambda m: (401, "secret"), tries=2).complete([])
    tries = iter([(503, ""), (200, "ok")])
    assert assist.Retrying(lambda m: next(tries)).complete([]) == "ok"
    papers = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, text string, hash string")
    done, failed = assist.insights(assist.Scripted([json.dumps({"summary": " s  t ", "methods": ["X", "x", "", 3]})]), papers, workers=1)
    assert len(done) == 1 and len(failed) == 1 and json.loads(done[0][2])["methods"] == ["X"] and json.loads(done[0][2])["summary"] == "s t"
    cells = assist.trimmed(spark.sql("SELECT 1 AS a, array(1) AS embedding, sequence(1, 40) AS l, named_struct('insight_json', 'x', 'k', 'v') AS s"))
    row = cells.first()
    assert cells.columns == ["a", "l", "s"] and len(row["l"]) == 25 and row["s"].asDict() == {"k": "v"}


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "river stones and trees"), (2, "river river"), (3, "trees of stone"), (4, "nothing here")], "id bigint, text string")
    made, note = search.hybrid(docs, search.embed(docs), "river stones")
    rows = {r["id"]: r for r in made.collect()}
    assert note is None and rows[1]["matched_by"] == "keyword,semantic" and rows[1]["keyword_rank"] == 1 and rows[2]["keyword_rank"] is None
    made, note = search.hybrid(docs, None, "riv")
    assert note and {r["id"] for r in made.collect()} == {1, 2}
    assert search.hybrid(docs, None, "r")[0].count() == 0
    with pytest.raises(search.SemanticUnavailable):
        search.check_model(spark.createDataFrame([("m", 8)], "model string, dimensions int"), "m", 9)
