"""The property graph as lazy tables, and its projection from order data: orders are papers, suppliers are authors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    papers: DataFrame  # id, title, year, is_stub, price
    cites: DataFrame  # src, dst
    authors: DataFrame  # id, name
    wrote: DataFrame  # author_id, paper_id, position
    affiliated: DataFrame  # author_id, institution_id, institution
    venues: DataFrame  # paper_id, venue
    topics: DataFrame  # paper_id, topic_id, score
    keywords: DataFrame  # paper_id, keyword


def from_orders(spark: SparkSession, folder: str) -> Graph:
    """An order cites the order before it that holds the same part: a dated graph without cycles."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    orders, lines, part = read("orders"), read("lineitem"), read("part")
    dated = lines.select("l_orderkey", "l_partkey", "l_linenumber").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    turn = Window.partitionBy("l_partkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber")
    cites = dated.select(F.col("l_orderkey").alias("src"), F.lag("l_orderkey").over(turn).alias("dst")).where("dst IS NOT NULL AND dst <> src").distinct()
    held = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    supplier, nation = read("supplier"), read("nation")
    return Graph(
        papers=orders.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "P").alias("is_stub"), F.col("o_totalprice").alias("price")),
        cites=cites,
        authors=supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        wrote=lines.groupBy(F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("paper_id")).agg(F.min("l_linenumber").alias("position")),
        affiliated=supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("author_id"), F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("institution")),
        venues=orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("paper_id"), F.col("c_mktsegment").alias("venue")),
        topics=held.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("topic_id")).agg(F.round(F.sum("l_quantity"), 2).alias("score")),
        keywords=held.select(F.col("l_orderkey").alias("paper_id"), F.explode(F.split("p_name", " ")).alias("keyword")).distinct(),
    )


#: The same tables for the DuckDB check.
SQL = """
paper AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderkey AS title, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus = 'P' AS is_stub, o_totalprice AS price FROM orders),
cites AS (SELECT DISTINCT src, dst FROM (SELECT l_orderkey AS src, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE dst IS NOT NULL AND dst <> src),
wrote AS (SELECT l_suppkey AS author_id, l_orderkey AS paper_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2),
affil AS (SELECT s_suppkey AS author_id, n_nationkey AS institution_id, n_name AS institution FROM supplier JOIN nation ON s_nationkey = n_nationkey),
venue AS (SELECT o_orderkey AS paper_id, c_mktsegment AS venue FROM orders JOIN customer ON o_custkey = c_custkey),
topic AS (SELECT l_orderkey AS paper_id, p_brand AS topic_id, round(sum(l_quantity), 2) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
keyword AS (SELECT DISTINCT l_orderkey AS paper_id, unnest(string_split(p_name, ' ')) AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey),
und AS (SELECT src AS a, dst AS b FROM cites UNION SELECT dst, src FROM cites),
indeg AS (SELECT dst AS id, count(*) AS n FROM cites GROUP BY 1)
"""


def sql(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{''.join(f', {m}' for m in more)} {body}"
