"""Reading order, seed checks, nested pages and the streaming ingest."""

import json

from citelake.operators.reading import order
from citelake.sources import openalex, seed
from citelake.streaming import ingest


def test_order():
    years = {10: 1990, 20: 1985, 30: 2001, 40: None, 50: 1999}
    assert order(list(years.items()), [(20, 10), (30, 20), (50, 40)]) == [10, 20, 30, 40, 50]
    assert order(list(years.items()), [(10, 20), (20, 10)]) == [50, 30, 40, 20, 10] or order(list(years.items()), [(10, 20), (20, 10)])[:2] == [50, 30]
    assert order([(7, 3), (8, 3)], [(7, 7)]) == [7, 8]


def test_reading_path(spark):
    from citelake.operators.reading import reading_path

    papers = spark.createDataFrame([(1, 2000, 5.0), (2, 2003, 1.0), (3, 1999, 1.0), (4, 2010, 0.5)], "id bigint, year int, score double")
    cites = spark.createDataFrame([(2, 1), (4, 1), (4, 2), (2, 2), (9, 1)], "src bigint, dst bigint")
    got = {r["id"]: r for r in reading_path(papers, cites, 4).collect()}
    assert [got[i]["place"] for i in (3, 1, 2, 4)] == [1, 2, 3, 4] and got[1]["cited_by"] == 2 and got[4]["builds_on"] == [1, 2]
    assert got[3]["reason"].startswith("A place to start") and "2 papers" in got[1]["reason"]


def test_source_over_stored_works(spark):
    from citelake.sources import base

    page = {"results": [{"id": "https://x.org/W1", "title": "Rivers of salt", "publication_year": 2001, "authorships": [{"author": {"id": "https://x.org/A7"}}], "referenced_works": ["https://x.org/W2"]}, {"id": "https://x.org/W2", "doi": "https://doi.org/10.5/q", "title": "Salt", "publication_year": 1990}]}
    source = base.StoredWorks(openalex.works(spark, spark.createDataFrame([(json.dumps(page),)], "payload string")))
    ids = lambda df: sorted(r["i"] for r in df.selectExpr("work.id AS i").collect())
    one, two = "https://x.org/W1", "https://x.org/W2"
    assert ids(source.search("salt")) == [one, two] and ids(source.search("SALT rivers")) == [one] and ids(source.search("salt", year_to=1995)) == [two]
    assert ids(source.lookup(["w1", "10.5/Q"])) == [one, two] and ids(source.citing("W2")) == [one] and ids(source.references("W1")) == [two] and ids(source.of_author("A7")) == [one]
    good, bad = base.split_valid(source.records(source.works))
    assert good.count() == 2 and bad.count() == 0
    answers = iter([([1, 2], "c"), ([3, 4], "d"), ([], None)])
    assert list(base.pages(lambda cursor: next(answers))) == [[1, 2], [3, 4]]
    assert list(base.pages(lambda cursor: ([1, 2], "c"), most=3)) == [[1, 2], [1]]
    waits, replies = [], iter([(429, {"Retry-After": "90"}, None), (503, {}, None), (200, {}, "body")])
    assert base.patient(lambda: next(replies), sleep=waits.append) == "body" and waits[0] == 60 and 1 <= waits[1] <= 2
    assert base.patient(lambda: (404, {}, None)) is None


def test_load_is_idempotent_and_keeps_references(spark, tmp_path):
    from citelake.operators import load

    person = lambda name: {"name": name, "key": None}
    paper = lambda key, title, cites, people: {"key": key, "title": title, "year": 2000, "venue": "v", "topics": ["t"], "keywords": ["Salt", "salt", "!"], "cites": cites, "authors": people}
    data = {"dataset": "d", "version": 1, "topics": [{"key": "t", "name": "Seas"}], "venues": [{"key": "v", "name": "Acta"}], "papers": [paper("a", "On rivers", ["b"], [person("Ann Bee"), person("Cy Dee")]), paper("b", "On seas", [], [person("Ann Bee"), person("Cy Dee")])]}
    (tmp_path / "seed.json").write_text(json.dumps(data))
    records = load.from_seed(seed.load(spark, str(tmp_path / "seed.json")))
    first = load.load(load.empty(spark), records)
    sizes = {k: v.count() for k, v in first.tables.items()}
    assert (sizes["paper"], sizes["author"], sizes["cites"], sizes["wrote"], sizes["keyword"], sizes["topic"]) == (2, 2, 1, 4, 1, 1)
    again = load.load(first.tables, records, size=1)
    assert {k: v.count() for k, v in again.tables.items()} == sizes and again.counts["papers_created"] == 0 and again.counts["stubs_created"] == 0


def test_store_runs_vectors_and_insights(spark, tmp_path):
    from pyspark.sql import functions as F

    from citelake.operators import search, store

    held = store.Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "salt river"), (2, "sea"), (3, " ")], "id bigint, text string")
    assert store.embed_pending(held, docs) == {"scanned": 3, "embedded": 2, "unchanged": 0, "without_text": 1}
    assert store.embed_pending(held, docs.withColumn("text", F.when(F.col("id") == 2, "seas").otherwise(F.col("text"))))["embedded"] == 1
    assert held.read("vectors").count() == 2
    try:
        store.write_vectors(held, held.read("vectors").select("id", "hash", "vector"), "other")
        raise AssertionError
    except search.SemanticUnavailable:
        pass
    store.create_run(held, "r1")
    try:
        store.create_run(held, "r2")
        raise AssertionError
    except store.Conflict:
        pass
    assert store.execute(held, "r1", lambda: 5) == 5 and store.list_runs(held).first()["status"] == "succeeded"
    store.create_run(held, "r3")
    try:
        store.execute(held, "r3", lambda: 1 / 0)
        raise AssertionError
    except ZeroDivisionError:
        pass
    assert store.step_run(held, "r3", "running").where("id = 'r3'").first()["status"] == "running"
    cites = spark.createDataFrame([(1, 2), (3, 2), (1, 3)], "src bigint, dst bigint")
    papers = spark.createDataFrame([(1, False, "a"), (2, True, "b"), (3, True, None)], "id bigint, is_stub boolean, doi string")
    assert [r["id"] for r in store.hydration_queue(cites, papers, "doi", 5).collect()] == [2]
    assert store.hydration_queue(cites, papers, "doi", 5, store.attempted(held, cites.selectExpr("dst AS id"))).count() == 0
    assert "| 1 | False |" in store.report(papers.where("id = 1").select("id", "is_stub"))


def test_seed_problems(spark, tmp_path):
    paper = lambda key, year, cites, venue="v": {"key": key, "title": key, "year": year, "venue": venue, "topics": ["t"], "cites": cites}
    data = {"dataset": "d", "version": 1, "topics": [{"key": "t"}], "venues": [{"key": "v"}], "papers": [paper("a", 2000, []), paper("b", 1999, ["a", "b", "z"], "w"), paper("a", 2000, [])]}
    (tmp_path / "seed.json").write_text(json.dumps(data))
    got = {tuple(r) for r in seed.problems(seed.load(spark, str(tmp_path / "seed.json"))).collect()}
    assert got == {("repeated key", "a"), ("unknown venue", "b"), ("unknown citation", "b"), ("cites itself", "b"), ("cites a later paper", "b")}


def test_works(spark):
    page = {"meta": {"count": 1}, "results": [{"id": "https://x.org/W1", "doi": "https://doi.org/10.48550/arXiv.1901.00002", "title": None, "display_name": "A &amp; B", "publication_year": 2019, "publication_date": "2019-02-30", "abstract_inverted_index": {"We": [0], "test": [1]}, "authorships": [{"author": {"id": "https://x.org/A1", "display_name": None}, "raw_author_name": "Ann"}, {"author": {}}], "referenced_works": ["https://x.org/W2"]}]}
    row = openalex.records(openalex.works(spark, spark.createDataFrame([(json.dumps(page),)], "payload string"))).first()
    assert (row["openalex_id"], row["arxiv_id"], row["title"], row["abstract"], row["publication_date"], row["references"]) == ("W1", "1901.00002", "A & B", "We test", None, ["W2"])
    assert [a["name"] for a in row["authors"]] == ["Ann"]


def test_streaming_ingest(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [("s", "1", "a", "2024-01-01 00:00:00"), ("s", "1", "b", "2024-01-01 01:00:00"), ("s", "2", "c", "2024-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "source string, external_id string, payload string, fetched_at string").selectExpr("source", "external_id", "payload", "to_timestamp(fetched_at) AS fetched_at")
    frame.write.json(source)
    for _ in range(2):
        ingest.start(ingest.fresh(ingest.read(spark, source)), target, checkpoint).awaitTermination()
    assert {(r["external_id"], r["payload"]) for r in ingest.current(spark, target).collect()} == {("1", "b"), ("2", "c")}
