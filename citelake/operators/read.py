"""Relational reads of the graph: projections, expansions, groupings, rankings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.graph import Graph

MAX_PAGE = 100


def not_stub() -> Column:
    return ~F.coalesce(F.col("is_stub"), F.lit(False))


def in_degree(g: Graph) -> DataFrame:
    return g.cites.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def out_degree(g: Graph) -> DataFrame:
    return g.cites.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def degrees(g: Graph) -> DataFrame:
    made = g.papers.select("id").join(in_degree(g), "id", "left").join(out_degree(g), "id", "left")
    return made.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")))


def undirected(cites: DataFrame) -> DataFrame:
    """Both directions of every edge once: (a, b)."""
    return cites.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(cites.select("dst", "src")).distinct()


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: str | list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; the rank limit is pushed below the shuffle."""
    turn = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page numbers start at 1, sizes go to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def listing(papers: DataFrame, year_from: int | None = None, year_to: int | None = None, topics: DataFrame | None = None, topic: str | None = None) -> DataFrame:
    """Papers without stubs; every filter that is given applies."""
    out = papers.where(not_stub())
    if year_from is not None:
        out = out.where(F.col("year") >= year_from)
    if year_to is not None:
        out = out.where(F.col("year") <= year_to)
    if topic is not None:
        out = out.join(topics.where(F.col("topic_id") == topic).select(F.col("paper_id").alias("id")), "id", "left_semi")
    return out


def author_lists(g: Graph, of: DataFrame, limit: int) -> DataFrame:
    """(id, authors): names by position, at most limit, of the papers in ``of``."""
    chosen = g.wrote.join(of.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    first = top_per_group(chosen, "paper_id", limit, F.col("position"), F.col("author_id")).join(g.authors, F.col("author_id") == g.authors["id"])
    return first.groupBy(F.col("paper_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "author_id", "name"))), lambda x: x["name"]), ", ").alias("authors"))


def summaries(g: Graph, of: DataFrame, authors: int = 6) -> DataFrame:
    """The summary row of the papers in ``of``: chosen first, enriched after."""
    venue = g.venues.groupBy(F.col("paper_id").alias("id")).agg(F.min("venue").alias("venue"))
    made = of.join(in_degree(g), "id", "left").join(venue, "id", "left").join(author_lists(g, of, authors), "id", "left")
    return made.withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).withColumn("is_stub", F.coalesce("is_stub", F.lit(False)))


def expand(g: Graph, seed: int, outgoing: bool) -> DataFrame:
    """Papers that the seed cites, or that cite it."""
    near, far = ("src", "dst") if outgoing else ("dst", "src")
    return g.papers.join(g.cites.where(F.col(near) == seed).select(F.col(far).alias("id")), "id")


def neighbourhood(g: Graph, seeds: list[int], hops: int, cap: int | None = None) -> DataFrame:
    """(id, hop) within ``hops`` undirected steps; with a cap, the least ids of a hop enter first."""
    edges = undirected(g.cites)
    spark = g.papers.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in seeds], "id bigint, hop int")
    frontier, room = seen, None if cap is None else cap - len(set(seeds))
    for hop in range(1, hops + 1):
        step = edges.join(F.broadcast(frontier.select(F.col("id").alias("a"))) if hop == 1 else frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        if room is not None:
            step = step.orderBy("id").limit(max(room, 0))
        frontier = step.withColumn("hop", F.lit(hop)).persist()
        if room is not None:
            room -= frontier.count()
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def co_occurrence(pairs: DataFrame, item: str, context: str, least: int = 1) -> DataFrame:
    """(a, b, weight): items a < b that share at least ``least`` contexts."""
    left = pairs.select(F.col(context).alias("c"), F.col(item).alias("a"))
    right = pairs.select(F.col(context).alias("c"), F.col(item).alias("b"))
    return left.join(right, "c").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def group_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group, other, outgoing, incoming): links between different groups in both directions."""
    a, b = members.select(F.col("id").alias("src"), F.col("grp").alias("g")), members.select(F.col("id").alias("dst"), F.col("grp").alias("o"))
    out = edges.join(a, "src").join(b, "dst").where("g <> o").groupBy("g", "o").agg(F.count("*").alias("n"))
    into = out.select(F.col("o").alias("g"), F.col("g").alias("o"), F.col("n").alias("incoming"))
    joined = out.withColumnRenamed("n", "outgoing").join(into, ["g", "o"], "full")
    return joined.select("g", "o", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "incoming")))


# Pseudo-papers of a window, growth from which a topic rises or declines, papers that make one emerging.
SMOOTHING, RISING, DECLINING, EMERGING = 0.5, 1.5, 0.67, 2
TREND_ORDER = ("emerging", "rising", "steady", "declining")


def windows(topic_years: DataFrame, totals: DataFrame, window: int) -> DataFrame:
    """(topic_id, total, recent, previous, all_recent, all_previous): papers of two adjacent windows that end at the last
    year of all papers, of each topic and of all."""
    last = totals.agg(F.max("year").alias("last"))
    within = lambda lo, hi: (F.col("year") > F.col("last") - hi) & (F.col("year") <= F.col("last") - lo)
    part = lambda lo, hi: F.sum(F.when(within(lo, hi), F.col("papers")).otherwise(0))
    whole = totals.join(F.broadcast(last)).agg(part(0, window).alias("all_recent"), part(window, 2 * window).alias("all_previous"))
    own = topic_years.join(F.broadcast(last)).groupBy("topic_id").agg(
        F.sum("papers").alias("total"), part(0, window).alias("recent"), part(window, 2 * window).alias("previous"),
        F.array_sort(F.collect_list(F.struct("year", "papers"))).alias("series"),
    )
    return own.join(F.broadcast(whole))


def trends(topic_years: DataFrame, totals: DataFrame, window: int = 3, least: int = 2, limit: int = 30) -> DataFrame:
    """The first topics by label, then growth of their smoothed share of the papers between two windows of years."""
    own = windows(topic_years, totals, window).where(F.col("total") >= least)
    share = lambda n, m: F.when(F.col(m) > 0, F.col(n) / F.col(m)).otherwise(0.0)
    smooth = lambda n, m: (F.col(n) + SMOOTHING) / (F.col(m) + 2 * SMOOTHING)
    still = (F.col("recent") == 0) & (F.col("previous") == 0)
    growth = F.when(still, 1.0).otherwise(smooth("recent", "all_recent") / smooth("previous", "all_previous"))
    rises = (F.col("growth") >= RISING) & (F.col("recent") > F.col("previous"))
    falls = (F.col("growth") <= DECLINING) & (F.col("recent") < F.col("previous"))
    label = F.when((F.col("previous") == 0) & (F.col("recent") >= EMERGING), "emerging").when(rises, "rising").when(falls, "declining").otherwise("steady")
    made = own.withColumn("growth", growth).withColumn("label", label)
    made = made.withColumns({"share_recent": share("recent", "all_recent"), "share_previous": share("previous", "all_previous")})
    place = F.array_position(F.array(*map(F.lit, TREND_ORDER)), F.col("label"))
    return made.orderBy(place, still, F.desc("growth"), F.desc("total"), "topic_id").limit(limit).drop("all_recent", "all_previous")
