"""Keyed upserts, node merges, identifier resolution and constraint checks over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers from strongest to weakest.
IDENTIFIERS = ("doi", "openalex_id", "arxiv_id", "s2_id", "seed_key")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], first: tuple[str, ...] = (), last: tuple[str, ...] = (), union: tuple[str, ...] = (), any_true: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Full outer merge by key: ``first`` keeps the old value, ``last`` takes the new one, ``union`` joins arrays.

    Rows of ``new`` that share a key are merged by the same rules, in the order of a column, else of their values.
    """
    keys = [key] if isinstance(key, str) else list(key)
    pick = lambda f, c: f(F.struct(*([F.col(order)] if order else []), F.col(c).alias("v")), F.col(c).isNotNull())["v"]
    least, most = lambda x, there: F.min(F.when(there, x)), lambda x, there: F.max(F.when(there, x))
    merged = [*(pick(least, c).alias(c) for c in first), *(pick(most, c).alias(c) for c in last), *(F.max(c).alias(c) for c in any_true)]
    merged += [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in union]
    new = new.groupBy(*keys).agg(*merged) if merged else new.select(*keys).distinct()
    a, b = old.alias("a"), new.alias("b")
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    out += [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in first]
    out += [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in last]
    out += [F.array_sort(F.array_union(F.coalesce(f"a.{c}", F.array()), F.coalesce(f"b.{c}", F.array()))).alias(c) for c in union]
    out += [(F.coalesce(f"a.{c}", F.lit(False)) | F.coalesce(f"b.{c}", F.lit(False))).alias(c) for c in any_true]
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full").select(*out)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last."""
    turn = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(turn)).where("_r = 1").drop("_r")


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or not unique."""
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(f"n > 1 OR {null}")


def merge_nodes(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges (src, dst) with merged nodes (old, kept) replaced; loops and doubles go."""
    a, b = merges.select(F.col("old").alias("src"), F.col("kept").alias("s")), merges.select(F.col("old").alias("dst"), F.col("kept").alias("d"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).where("src <> dst").distinct()


def identifier_matches(records: DataFrame, nodes: DataFrame, identifiers: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """(record, node, rank): the node of each record that shares an identifier: no stub first, then strongest, then least id.

    The first node of each identifier is found before records meet it, so no pairs are made.
    """

    def long(df: DataFrame, name: str, *more: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), F.col(k).alias("value")) for i, k in enumerate(identifiers))))
        return df.select(F.col("id").alias(name), *more, pairs.alias("x")).select(name, *more, "x.*").where("value IS NOT NULL")

    first = long(nodes, "node", "is_stub").groupBy("kind", "value").agg(F.min(F.struct(F.coalesce("is_stub", F.lit(False)).alias("stub"), "node")).alias("n"))
    hits = long(records, "record").join(first, ["kind", "value"])
    best = hits.groupBy("record").agg(F.min(F.struct("n.stub", "rank", "n.node")).alias("m"))
    return best.select("record", "m.node", "m.rank")


def resolve_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst, is_new): a reference resolves to the owner of its identifier, else to one stub for each identifier."""
    joined = refs.join(index, "value", "left")
    stub = F.concat(F.lit("stub:"), F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 16))
    return joined.select("src", F.coalesce("owner", stub).alias("dst"), F.col("owner").isNull().alias("is_new")).where("src <> dst").distinct()


def hydration_queue(cites: DataFrame, papers: DataFrame, k: int) -> DataFrame:
    """The most cited stubs."""
    cited = cites.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return papers.where("is_stub").select("id").join(cited, "id").orderBy(F.desc("n"), "id").limit(k)
