"""Composed reads: rankings by metric, communities, related and recommended papers, typed paths, reading paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.graph import Graph
from citelake.operators import algorithms as alg
from citelake.operators import read, reading, search
from citelake.operators.algorithms import checkpointed

NEAR_NODES = 5000
POOL = 50
# The eight kinds of links, and how a sentence says them.
PHRASES = {
    "CITES": "cites", "WROTE": "wrote", "HAS_TOPIC": "has topic", "PUBLISHED_IN": "published in", "HAS_KEYWORD": "has keyword",
    "AFFILIATED_WITH": "affiliated with", "COLLABORATED_WITH": "collaborated with", "RELATED_TO": "co-occurs with",
}
NOTES = {
    "pagerank": "Scores depend on the papers that were collected.", "betweenness": "Estimated from a sample of sources in large graphs.",
    "in_degree": "Counts only citations between collected papers.", "paper_count": "Counts only collected papers.",
}
METRIC_FOR = {("paper", "paper_count"): "in_degree", ("author", "in_degree"): "paper_count"}


def ranking_choice(entity: str, metric: str) -> str:
    """The metric that a ranking of an entity uses: one that the other kind alone has is replaced by its own."""
    return METRIC_FOR.get((entity, metric), metric)


def influential(rows: DataFrame, metrics: DataFrame, metric: str, k: int, note: bool = False) -> DataFrame:
    """The k rows with the highest metric, null metrics left out; optionally the caveat of the metric as a column."""
    scored = rows.join(metrics.select("id", F.col(metric).cast("double").alias("score")), "id").where("score IS NOT NULL")
    best = read.top_k(scored, k, F.desc("score"), F.col("id"))
    return best.withColumn("note", F.lit(NOTES.get(metric))) if note else best


def sorted_papers(g: Graph, by: str, metrics: DataFrame | None = None) -> list[Column]:
    """The order of a listing: by year, PageRank or citations, nulls where an unordered store puts them, ties by id."""
    if by == "year":
        return [F.desc_nulls_first("year"), F.asc_nulls_last("title"), F.col("id")]
    return [F.desc(F.coalesce(F.col("pagerank" if by == "pagerank" else "in_degree"), F.lit(0))), F.desc_nulls_first("year"), F.col("id")]


def personal_rank(g: Graph, seeds: list[int], k: int, iterations: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """(id, score): personalised PageRank from the seeds over their neighbourhood of two steps, without the seeds."""
    near = checkpointed(read.neighbourhood(g, seeds, 2, cap=NEAR_NODES).select("id"))
    edges = read.induced(read.undirected(g.cites).toDF("src", "dst"), near)
    spark = g.papers.sparkSession
    personal = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "id bigint").join(near, "id", "left_semi")
    ranks = alg.pagerank(near, edges, iterations, personal=personal, tolerance=tolerance)
    return read.top_k(ranks.join(F.broadcast(personal), "id", "left_anti"), k, F.round("score", 12).desc(), F.col("id"))


def related(g: Graph, paper: int, k: int, iterations: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """(id, title, score, explanation): papers that short citation paths lead to."""
    hits = personal_rank(g, [paper], k, iterations, tolerance).join(g.papers.select("id", "title"), "id")
    return hits.withColumn("explanation", F.format_string("Short citation paths lead here (personalised PageRank %.4f).", "score"))


def linked_seeds(g: Graph, seeds: list[int]) -> DataFrame:
    """(id, linked): the seeds that a paper cites or is cited by."""
    chosen = g.papers.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "a bigint")
    return read.undirected(g.cites).join(F.broadcast(chosen), "a").groupBy(F.col("b").alias("id")).agg(F.array_sort(F.collect_set("a")).alias("linked"))


def recommend(g: Graph, vectors: DataFrame | None, seeds: list[int], limit: int, iterations: int = 100, tolerance: float | None = 1e-8) -> tuple[DataFrame, str | None]:
    """(id, score, matched_by, linked, reasons) for a reading list, and a note if there are no vectors.

    Pools by personalised PageRank and by nearness to the centroid of the list are fused by rank; the limit holds before
    stubs are left out. A seed that is no paper is an error.
    """
    seeds = list(dict.fromkeys(seeds))
    known = {r["id"] for r in g.papers.where(F.col("id").isin(seeds)).select("id").collect()}
    if missing := [s for s in seeds if s not in known]:
        raise KeyError(f"no such papers: {missing[:5]}")
    lists = {"graph": search.ranked(personal_rank(g, seeds, POOL, iterations, tolerance).select("id", F.round("score", 12).alias("score")))}
    note = None
    own = vectors.where(F.col("id").isin(seeds)) if vectors is not None else None
    middle = search.centroid(own.withColumn("all", F.lit(1)), "all").orderBy("pos").collect() if own is not None else []
    if middle:
        near = search.knn(vectors, [r["value"] for r in middle], POOL + len(seeds)).where(~F.col("id").isin(seeds))
        lists["semantic"] = search.ranked(near.orderBy(F.round("cosine", 9).desc(), "id").limit(POOL).select("id", F.round("cosine", 9).alias("score")))
    else:
        note = "These papers have no embeddings, so citation links alone are used."
    best = search.fuse(lists).orderBy(F.round("score", 12).desc(), "id").limit(limit)
    made = best.join(g.papers.where(read.not_stub()).select("id"), "id", "left_semi").join(linked_seeds(g, seeds), "id", "left")
    said = F.array_compact(F.array(
        F.when(F.size("linked") > 0, F.format_string("Linked with %d of your papers.", F.size("linked"))),
        F.when(F.contains("matched_by", F.lit("graph")), "Short citation paths lead here."),
        F.when(F.contains("matched_by", F.lit("semantic")), "Close in meaning to your list."),
    ))
    return made.withColumn("reasons", said), note


def community_summaries(members: DataFrame, topics: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """(community, size, rank, label, top_topics) of members (id, community) that have at least ``least`` of them."""
    sizes = members.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") >= least)
    order = F.struct((-F.col("size")).alias("s"), F.col("first").alias("f"))
    ranked = F.array_sort(F.collect_list(order))
    places = sizes.agg(ranked.alias("all")).select(F.posexplode("all").alias("rank", "x")).select("rank", F.col("x.f").alias("first"))
    said = members.join(topics.select(F.col("paper_id").alias("id"), "topic_id"), "id").groupBy("community", "topic_id").agg(F.count("*").alias("n"))
    best = read.top_per_group(said, "community", top, F.desc("n"), F.col("topic_id"))
    listed = best.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic_id"))), lambda x: x["topic_id"]).alias("top_topics"))
    made = sizes.join(places, "first").join(listed, "community", "left")
    return made.select("community", "size", "rank", F.get("top_topics", 0).alias("label"), "top_topics")


def community_detail(g: Graph, members: DataFrame, community, k: int = 15) -> DataFrame:
    """(part, key, n): authors, institutions, topics and years of a community of papers, the first k of each but years."""
    own = checkpointed(members.where(F.col("community") == community).select(F.col("id").alias("paper_id")))
    wrote = g.wrote.join(own, "paper_id", "left_semi")
    parts = {
        "author": wrote.join(g.authors, F.col("author_id") == g.authors["id"]).select(F.col("name").alias("key")),
        "institution": wrote.join(g.affiliated, "author_id").select(F.col("institution").alias("key")),
        "topic": g.topics.join(own, "paper_id", "left_semi").select(F.col("topic_id").alias("key")),
    }
    out = g.papers.join(own, F.col("id") == F.col("paper_id"), "left_semi").where("year IS NOT NULL").groupBy(F.col("year").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("year").alias("part"), "key", "n")
    for name, rows in parts.items():
        counted = rows.groupBy("key").agg(F.count("*").alias("n"))
        out = out.unionByName(read.top_k(counted, k, F.desc("n"), F.col("key")).select(F.lit(name).alias("part"), "key", "n"))
    return out


def collaboration(g: Graph) -> tuple[DataFrame, DataFrame]:
    """All authors, those without co-authors too, and their weighted links."""
    return g.authors.select("id"), read.co_occurrence(g.wrote, "author_id", "paper_id")


def typed_edges(g: Graph, kinds: list[str] | None = None) -> DataFrame:
    """(src, dst, type) over nodes named by kind and id, of the kinds of links asked for."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    link = lambda df, a, b, name: df.select(a.alias("src"), b.alias("dst"), F.lit(name).alias("type"))
    known = {
        "CITES": lambda: link(g.cites, node("paper", "src"), node("paper", "dst"), "CITES"),
        "WROTE": lambda: link(g.wrote, node("author", "author_id"), node("paper", "paper_id"), "WROTE"),
        "HAS_TOPIC": lambda: link(g.topics, node("paper", "paper_id"), node("topic", "topic_id"), "HAS_TOPIC"),
        "PUBLISHED_IN": lambda: link(g.venues, node("paper", "paper_id"), node("venue", "venue"), "PUBLISHED_IN"),
        "HAS_KEYWORD": lambda: link(g.keywords, node("paper", "paper_id"), node("keyword", "keyword"), "HAS_KEYWORD"),
        "AFFILIATED_WITH": lambda: link(g.affiliated, node("author", "author_id"), node("institution", "institution_id"), "AFFILIATED_WITH"),
        "COLLABORATED_WITH": lambda: link(read.co_occurrence(g.wrote, "author_id", "paper_id"), node("author", "a"), node("author", "b"), "COLLABORATED_WITH"),
        "RELATED_TO": lambda: link(read.co_occurrence(g.topics, "topic_id", "paper_id"), node("topic", "a"), node("topic", "b"), "RELATED_TO"),
    }
    kinds = list(dict.fromkeys(kinds or known))
    if not kinds or any(k not in known for k in kinds):
        raise ValueError(f"kinds of links are {', '.join(known)}")
    out = known[kinds[0]]()
    for k in kinds[1:]:
        out = out.unionByName(known[k]())
    return out.distinct()


def shortest_path(edges: DataFrame, source: str, target: str, limit: int = 6) -> DataFrame:
    """(step, src, dst, type): the links of one shortest undirected path, each in its own direction; no rows if there is
    none. Of several paths the one whose nodes come first, seen from the target."""
    if source == target or not 1 <= limit <= 8:
        raise ValueError("a path has two ends and 1 to 8 links")
    spark = edges.sparkSession
    way = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", F.lit(True).alias("ahead"))
    both = checkpointed(way.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type", F.lit(False).alias("ahead"))))
    seen = levels = spark.createDataFrame([(source, 0, None, None, None)], "id string, hop int, parent string, type string, ahead boolean")
    for hop in range(1, limit + 1):
        step = both.join(levels.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "type", "ahead")).alias("m"))
        levels = checkpointed(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), F.col("m.a").alias("parent"), "m.type", "m.ahead"))
        if levels.isEmpty():
            break
        seen = seen.unionByName(levels)
        if not levels.where(F.col("id") == target).isEmpty():
            break
    rows, at = [], target
    while at != source:  # at most limit lookups
        row = seen.where(F.col("id") == at).first()
        if row is None:
            rows = []
            break
        rows.append((row["hop"], row["parent"], at, row["type"]) if row["ahead"] else (row["hop"], at, row["parent"], row["type"]))
        at = row["parent"]
    return spark.createDataFrame(rows[::-1], "step int, src string, dst string, type string")


def describe(path: DataFrame, names: DataFrame) -> DataFrame:
    """One row: the links of a path as a sentence. names: (id, name)."""
    a, b = names.select(F.col("id").alias("src"), F.col("name").alias("x")), names.select(F.col("id").alias("dst"), F.col("name").alias("y"))
    phrase = F.coalesce(F.create_map(*(F.lit(v) for kv in PHRASES.items() for v in kv))[F.col("type")], F.col("type"))
    said = path.join(a, "src", "left").join(b, "dst", "left").select("step", F.concat_ws(" ", F.coalesce("x", "src"), phrase, F.coalesce("y", "dst")).alias("s"))
    return said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "s"))), lambda v: v["s"]), "; ").alias("explanation"))


def reading_path(g: Graph, length: int, topic: str | None = None, paper: int | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(id, place, cited_by, builds_on, reason) of a path through a topic's best papers, or through those around a paper."""
    if (topic is None) == (paper is None):
        raise ValueError("give a topic or a paper")
    scores = scores if scores is not None else read.in_degree(g).withColumnRenamed("in_degree", "score")
    papers = g.papers.where(read.not_stub())
    if topic is not None:
        papers = papers.join(g.topics.where(F.col("topic_id") == topic).select(F.col("paper_id").alias("id")), "id", "left_semi")
    else:
        papers = papers.join(read.neighbourhood(g, [paper], 2).select("id"), "id", "left_semi")
    return reading.reading_path(papers.join(scores, "id", "left").select("id", "year", F.coalesce("score", F.lit(0)).alias("score")), g.cites, length)


def neighbourhood_view(g: Graph, focus: int, depth: int, limit: int, fan_out: int = 25) -> tuple[DataFrame, bool]:
    """(id, hop) around a paper, itself first, and whether more were left out; the second step starts from the first
    ``fan_out`` papers of the first alone."""
    if depth not in (1, 2) or not 2 <= limit <= 300:
        raise ValueError("depth is 1 or 2, the limit 2 to 300")
    edges = read.undirected(g.cites)
    first = checkpointed(edges.where(F.col("a") == focus).select(F.col("b").alias("id")).orderBy("id").limit(limit))
    rows = g.papers.sparkSession.createDataFrame([(focus, 0)], "id bigint, hop int").unionByName(first.withColumn("hop", F.lit(1)))
    if depth == 2:
        start = first.orderBy("id").limit(fan_out).select(F.col("id").alias("a"))
        further = edges.join(F.broadcast(start), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(rows.select("id"), "id", "left_anti")
        rows = rows.unionByName(further.orderBy("id").limit(limit).withColumn("hop", F.lit(2)))
    rows = checkpointed(rows.orderBy("hop", "id").limit(limit + 1))
    return rows.orderBy("hop", "id").limit(limit), rows.count() > limit


def overview(g: Graph, limit: int, metrics: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """The papers that a picture of the whole shows, by PageRank if given, in-degree and id; the links among them; and
    whether there are more papers."""
    rows = g.papers.select("id").join(read.in_degree(g), "id", "left").na.fill(0, ["in_degree"])
    rows = rows.join(metrics.select("id", "pagerank"), "id", "left") if metrics is not None else rows.withColumn("pagerank", F.lit(None).cast("double"))
    some = checkpointed(read.top_k(rows, min(limit, 300) + 1, F.desc_nulls_last("pagerank"), F.desc("in_degree"), F.col("id")))
    shown = checkpointed(read.top_k(some, min(limit, 300), F.desc_nulls_last("pagerank"), F.desc("in_degree"), F.col("id")))
    return shown, read.induced(g.cites, shown), some.count() > min(limit, 300)


def view(nodes: DataFrame) -> DataFrame:
    """What a drawing needs of (id, title, in_degree, year): radius, short title, place of the year in the range shown."""
    span = nodes.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    short = F.when(F.length("title") > 40, F.concat(F.substring("title", 1, 39), F.lit("…"))).otherwise(F.col("title"))
    ramp = F.when(F.col("hi") > F.col("lo"), (F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    made = nodes.join(F.broadcast(span))
    return made.select("id", short.alias("label"), (4 + 2 * F.sqrt(F.col("in_degree").cast("double"))).alias("radius"), ramp.alias("year_place"))
