"""Reading order of a bounded set of papers: the best are chosen in Spark, their order is a topological sort."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_YEAR = 9999
#: Candidates that a path is chosen from at most.
MAX_CANDIDATES = 80


def order(papers: list[tuple[int, int | None]], edges: list[tuple[int, int]]) -> list[int]:
    """Cited before citing, earlier years first, ties by id; a cycle is broken at its least (year, id)."""
    key = {i: (y if y is not None else NO_YEAR, i) for i, y in papers}
    waits: dict[int, set[int]] = {i: set() for i in key}
    for s, d in edges:
        if s in key and d in key and s != d:
            waits[s].add(d)
    out: list[int] = []
    ready = [key[i] for i in key if not waits[i]]
    heapq.heapify(ready)
    left = set(key)
    while left:
        i = heapq.heappop(ready)[1] if ready else min(key[j] for j in left)[1]
        if i not in left:
            continue
        left.discard(i)
        out.append(i)
        for j in left:
            if i in waits[j]:
                waits[j].discard(i)
                if not waits[j]:
                    heapq.heappush(ready, key[j])
    return out


def reading_path(candidates: DataFrame, cites: DataFrame, length: int) -> DataFrame:
    """(id, place, cited_by, builds_on, reason) from candidates (id, year, score).

    The papers most cited among the candidates (then score, then id) are chosen and put in order; citations and what a
    paper builds on count inside the path.
    """
    chosen = candidates.orderBy(F.desc("score"), "id").limit(MAX_CANDIDATES)
    ends = lambda c: F.broadcast(chosen.select(F.col("id").alias(c)))  # noqa: E731  MAX_CANDIDATES rows
    among = cites.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()
    cited = among.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("cited"))
    best = chosen.join(cited, "id", "left").na.fill(0, ["cited"]).orderBy(F.desc("cited"), F.desc("score"), "id").limit(length)
    links = among.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("to"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        here = {int(i) for i in rows["id"]}
        pairs = [(int(i), int(d)) for i, to in zip(rows["id"], rows["to"], strict=True) if to is not None for d in to if int(d) in here]
        years = [(int(i), None if pd.isna(y) else int(y)) for i, y in zip(rows["id"], rows["year"], strict=True)]
        path = order(years, pairs)
        place = {i: k + 1 for k, i in enumerate(path)}
        before: dict[int, list[int]] = {i: [] for i in path}
        count = dict.fromkeys(path, 0)
        for s, d in pairs:
            count[d] += 1
            if place[d] < place[s]:
                before[s].append(d)
        builds = [sorted(before[i], key=place.__getitem__) for i in path]
        return pd.DataFrame({"id": path, "place": [place[i] for i in path], "cited_by": [count[i] for i in path], "builds_on": builds})

    made = best.join(links, "id", "left").withColumn("path", F.lit(0)).groupBy("path").applyInPandas(run, "id bigint, place int, cited_by bigint, builds_on array<bigint>")
    cited_here = F.when(F.col("cited_by") > 0, F.format_string("Cited by %d papers of this path.", "cited_by"))
    builds = F.when(F.size("builds_on") > 0, F.format_string("Builds on %d earlier papers of it.", F.size("builds_on")))
    alone = F.when(F.col("place") == 1, "A place to start: it needs no other paper of the path.").otherwise("On the subject, and independent of the other papers.")
    reason = F.concat_ws(" ", cited_here, builds)
    return made.withColumn("reason", F.when(reason == "", alone).otherwise(reason))
