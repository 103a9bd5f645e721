"""Ingestion and resolution queries over records made from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.catalog import register
from citelake.functions import normalize as nz
from citelake.functions import sql_guard
from citelake.graph import sql
from citelake.operators import ingest
from citelake.plans.graph_queries import graph

RAW_DOI = "CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.' || (1000 + o_orderkey % 9000) || '/AbC' || o_orderkey WHEN 1 THEN 'doi: 10.1234/X' || o_orderkey WHEN 2 THEN 'not-a-doi' ELSE NULL END"


@register("j02_doi", f"SELECT id, CASE WHEN regexp_matches(b, '^10\\.\\d{{4,9}}/\\S+$') THEN b END AS doi FROM (SELECT o_orderkey AS id, lower(trim(regexp_replace(trim({RAW_DOI}), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '', 'i'))) AS b FROM orders)")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("id"), nz.doi(F.expr(RAW_DOI)).alias("doi"))


RAW_ARXIV = "CASE o_orderkey % 3 WHEN 0 THEN 'arXiv:' || lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR(9)), 5, '0') || 'v2' WHEN 1 THEN 'hep-th/' || lpad(CAST(o_orderkey AS VARCHAR(9)), 7, '0') || 'v1' ELSE '2104.0' || o_orderkey END"


@register("j03_arxiv", f"SELECT id, coalesce(nullif(regexp_extract(a, '(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?$', 1), ''), nullif(regexp_extract(lower(a), '([a-z-]+(\\.[a-z]{{2}})?/\\d{{7}})(v\\d+)?$', 1), '')) AS arxiv FROM (SELECT o_orderkey AS id, {RAW_ARXIV} AS a FROM orders)")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("id"), nz.arxiv_id(F.expr(RAW_ARXIV.replace("VARCHAR(9)", "string"))).alias("arxiv"))


RAW_ORCID = "'https://orcid.org/0000-0002-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR(9)), 4, '0') || '-009x' || CASE WHEN s_suppkey % 5 = 0 THEN '/about' ELSE '' END"


@register("j04_orcid", f"SELECT s_suppkey AS id, nullif(upper(regexp_extract({RAW_ORCID}, '(\\d{{4}}-\\d{{4}}-\\d{{4}}-\\d{{3}}[\\dxX])$', 1)), '') AS orcid FROM supplier")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_suppkey").alias("id"), nz.orcid(F.expr(RAW_ORCID.replace("VARCHAR(9)", "string"))).alias("orcid"))


@register("j06_title_key", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("id"), nz.title_key(F.col("p_name")).alias("key"))


@register("j07_abstract_rebuild", "SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS abstract FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) GROUP BY 1")
def _(spark, folder):
    said = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").cast("string").alias("word"), F.col("l_linenumber").cast("int").alias("p"))
    words = said.groupBy("l_orderkey", "word").agg(F.collect_set("p").alias("at"))
    made = words.groupBy(F.col("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("inverted"))
    return made.select("id", nz.rebuild_abstract(F.col("inverted")).alias("abstract"))


@graph("j14_author_overlap", sql("SELECT src, dst, round(n / least(a.k, b.k), 6) AS overlap FROM (SELECT c.src, c.dst, count(y.author_id) AS n FROM cites c JOIN wrote x ON x.paper_id = src LEFT JOIN wrote y ON y.paper_id = dst AND y.author_id = x.author_id GROUP BY 1, 2) JOIN (SELECT paper_id, count(*) AS k FROM wrote GROUP BY 1) a ON a.paper_id = src JOIN (SELECT paper_id, count(*) AS k FROM wrote GROUP BY 1) b ON b.paper_id = dst"))
def _(g):
    lists = g.wrote.groupBy("paper_id").agg(F.collect_set("author_id").alias("l"))
    a, b = lists.select(F.col("paper_id").alias("src"), F.col("l").alias("a")), lists.select(F.col("paper_id").alias("dst"), F.col("l").alias("b"))
    return g.cites.join(a, "src").join(b, "dst").select("src", "dst", F.round(nz.author_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@graph("j11_identifier_match", sql("SELECT record, node, rank FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY is_stub, rank, node) AS r FROM (SELECT a.id AS record, b.id AS node, b.is_stub, 0 AS rank FROM paper a JOIN paper b ON a.id % 500 = b.id % 500 UNION ALL SELECT a.id, b.id, b.is_stub, 1 FROM paper a JOIN paper b ON a.id % 300 = b.id % 300)) WHERE r = 1"))
def _(g):
    keys = g.papers.select("id", "is_stub", (F.col("id") % 500).cast("string").alias("doi"), (F.col("id") % 300).cast("string").alias("openalex_id"))
    return ingest.identifier_matches(keys, keys, ("doi", "openalex_id"))


@graph("j19_reference_resolution", sql("SELECT DISTINCT src, dst, is_new FROM (SELECT CAST(src AS VARCHAR) AS src, CASE WHEN dst % 5 = 0 THEN 'stub:' || substr(sha256('ref' || dst), 1, 16) ELSE CAST(dst AS VARCHAR) END AS dst, dst % 5 = 0 AS is_new FROM cites)"))
def _(g):
    refs = g.cites.select(F.col("src").cast("string").alias("src"), F.concat(F.lit("ref"), F.col("dst").cast("string")).alias("value"))
    index = g.papers.where("id % 5 <> 0").select(F.concat(F.lit("ref"), F.col("id").cast("string")).alias("value"), F.col("id").cast("string").alias("owner"))
    return ingest.resolve_references(refs, index)


@graph("j21_stub_hydration_queue", sql("SELECT id, n FROM indeg JOIN paper USING (id) WHERE is_stub ORDER BY n DESC, id LIMIT 25"))
def _(g):
    return ingest.hydration_queue(g.cites, g.papers, 25)


@graph("b01_upsert_policy", sql("SELECT coalesce(a.id, b.id) AS id, coalesce(a.title, b.title) AS title, coalesce(b.price, a.price) AS price FROM (SELECT * FROM paper WHERE id % 3 <> 0) a FULL JOIN (SELECT id, 'new' AS title, price + 1 AS price FROM paper WHERE id % 2 = 0) b ON a.id = b.id"))
def _(g):
    old = g.papers.where("id % 3 <> 0").select("id", "title", "price")
    return ingest.upsert(old, g.papers.where("id % 2 = 0").select("id", F.lit("new").alias("title"), (F.col("price") + 1).alias("price")), "id", first=("title",), last=("price",))


@graph("b05_insert_absent_edges", sql("SELECT src, dst, 'old' AS source FROM cites WHERE src % 2 = 0 UNION ALL SELECT src, dst, 'new' FROM cites WHERE src % 2 <> 0 AND src % 3 = 0"))
def _(g):
    edges = lambda where, name: g.cites.where(where).select("src", "dst", F.lit(name).alias("source"))
    return ingest.insert_absent(edges("src % 2 = 0", "old"), edges("src % 3 = 0", "new"), ["src", "dst"])


@graph("b07_node_merge", sql("SELECT DISTINCT s AS src, d AS dst FROM (SELECT CASE WHEN src % 10 = 3 THEN src - 1 ELSE src END AS s, CASE WHEN dst % 10 = 3 THEN dst - 1 ELSE dst END AS d FROM cites) WHERE s <> d"))
def _(g):
    return ingest.merge_nodes(g.cites, g.papers.where("id % 10 = 3").select(F.col("id").alias("old"), (F.col("id") - 1).alias("kept")))


@register("b12_latest_raw", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, folder):
    return ingest.latest(spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@register("b13_constraint_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def _(spark, folder):
    return ingest.violations(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@register("l01_sql_guard", "SELECT * FROM (VALUES ('SELECT 1 AS x FROM orders', true), ('DROP TABLE orders', false), ('SELECT o_orderkey FROM orders LIMIT 5000', false), ('SELECT nothing FROM orders', false), ('SELECT 1; SELECT 2', false)) t(statement, accepted)")
def _(spark, folder):
    spark.read.parquet(f"{folder}/orders.parquet").createOrReplaceTempView("orders")
    out = []
    for s in ("SELECT 1 AS x FROM orders", "DROP TABLE orders", "SELECT o_orderkey FROM orders LIMIT 5000", "SELECT nothing FROM orders", "SELECT 1; SELECT 2"):
        try:
            sql_guard.validate(spark, s, {"orders"})
            out.append((s, True))
        except sql_guard.Rejected:
            out.append((s, False))
    return spark.createDataFrame(out, "statement string, accepted boolean")
