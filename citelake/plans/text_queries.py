"""Search, vector, evaluation and streaming-twin queries over documents, embeddings, benchmark and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.catalog import register
from citelake.operators import evaluate, search
from citelake.streaming.limiter import admitted


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


W = "w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)"
BM25 = """f AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f),
h AS (SELECT id, ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / mean)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / mean)) AS score FROM f, s WHERE a > 0 AND b > 0),
k AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM h ORDER BY round(score, 9) DESC, id LIMIT 50)"""


@register("h01_bm25", f"WITH {W}, {BM25} SELECT id, round(score, 6) AS score FROM k")
def _(spark, folder):
    return search.bm25(_docs(spark, folder), [("the", False), ("with", False)], 50).select("id", F.round("score", 6).alias("score"))


@register("h05_text_hash", "SELECT doc_id AS id, substr(sha256(text), 1, 16) AS hash FROM documents")
def _(spark, folder):
    return _docs(spark, folder).select("id", search.text_hash(F.col("text")).alias("hash"))


@register("h06_hash_embeddings")
def _(spark, folder):
    return search.embed(_docs(spark, folder))


@register("h08_pending_embeddings", "SELECT doc_id AS id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE doc_id % 3 <> 0")
def _(spark, folder):
    docs = _docs(spark, folder)
    stored = docs.where("id % 3 = 0").select("id", search.text_hash(F.col("text")).alias("hash"), F.lit("hashing-256").alias("model"))
    return search.pending(docs, stored, "hashing-256")


COS = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
KNN = f"q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS id, {COS.format(a='embedding', b='e')} / (sqrt({COS.format(a='embedding', b='embedding')}) * sqrt({COS.format(a='e', b='e')})) AS cosine FROM embeddings, q WHERE vec_id <> 0)"


@register("h10_similar_vectors", f"WITH {KNN} SELECT id, round(cosine, 6) AS cosine, round((1 + cosine) / 2, 6) AS score FROM c ORDER BY c.cosine DESC, id LIMIT 10")
def _(spark, folder):
    rows = _vectors(spark, folder)
    query = rows.where("id = 0").first()["vector"]
    return search.knn(rows, list(query), 10, exclude=0).select("id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@register("h14_centroid", "WITH n AS (SELECT label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS z FROM embeddings), p AS (SELECT label, unnest(range(64)) AS pos, unnest(e)::DOUBLE / z AS v FROM n), m AS (SELECT label, pos, avg(v) AS m FROM p GROUP BY 1, 2), t AS (SELECT label, sqrt(sum(m * m)) AS t FROM m GROUP BY 1) SELECT label, CAST(pos AS INT) AS pos, round(m / t, 6) AS value FROM m JOIN t USING (label)")
def _(spark, folder):
    return search.centroid(_vectors(spark, folder), "label").select("label", "pos", F.round("value", 6).alias("value"))


@register("h11_rrf", f"WITH {W}, {BM25}, l AS (SELECT id, row_number() OVER (ORDER BY len, id) AS rank FROM f WHERE a > 0 AND b > 0 ORDER BY len, id LIMIT 50) SELECT id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(m, ',' ORDER BY m) AS matched_by FROM (SELECT id, rank, 'keyword' AS m FROM k UNION ALL SELECT id, rank, 'short' FROM l) GROUP BY 1")
def _(spark, folder):
    docs = _docs(spark, folder)
    keyword = search.ranked(search.bm25(docs, [("the", False), ("with", False)], 50).withColumn("score", F.round("score", 9)))
    said = docs.select("id", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    short = said.where("array_contains(w, 'the') AND array_contains(w, 'with')").select("id", F.size("w").alias("len")).orderBy("len", "id").limit(50)
    lists = {"keyword": keyword, "short": search.ranked(short.select("id", (-F.col("len")).alias("score")))}
    return search.fuse(lists).select("id", F.round("score", 9).alias("score"), "matched_by")


TOKENS = "t AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM {w}) GROUP BY 1, 2, 3)"
ITEMS = "iw AS (SELECT item_id AS query, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark), a AS (SELECT query, len(w) AS asked, unnest(w) AS term FROM iw)"
MANY = f"""{W}, {TOKENS.format(w='w')}, {ITEMS}, st AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT id, len FROM t)), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
sc AS (SELECT query, id, any_value(asked) AS asked, count(*) AS matched, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / mean))) AS score FROM t JOIN df USING (term) JOIN a USING (term), st GROUP BY 1, 2),
rk AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM sc QUALIFY rank <= 10), rel AS (SELECT query, id FROM sc WHERE matched = asked),
h AS (SELECT rel.query, rel.id, rank FROM rel LEFT JOIN rk USING (query, id)), g AS (SELECT query, count(*) AS n, count(*) FILTER (rank <= 10) AS found, min(rank) AS first, coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS gain FROM h GROUP BY 1),
q AS (SELECT item_id AS query, n, found, first, gain FROM benchmark LEFT JOIN g ON g.query = item_id)"""


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("query"), "text")


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 rankings of all documents for each benchmark item, held against the documents that have all of its words."""
    docs, asked = _docs(spark, folder), _asked(spark, folder)
    ranking = search.bm25_many(docs, asked, 10).select("query", F.col("id").alias("item"), "rank")
    return evaluate.retrieval(ranking, search.holders(docs, asked).withColumnRenamed("id", "item"), 10, asked)


@register("h01_bm25_many", f"WITH {MANY} SELECT query, id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM rk")
def _(spark, folder):
    return search.bm25_many(_docs(spark, folder), _asked(spark, folder), 10).select("query", "id", "rank", F.round("score", 4).alias("score"))


for _key, _name, _sql in (
    ("m01_recall", "recall", "round(coalesce(found / n, 1), 6)"), ("m02_hit", "hit", "CAST(coalesce(found, 0) > 0 AS INT)"),
    ("m03_mrr", "reciprocal_rank", "round(coalesce(1 / first, 0), 6)"),
    ("m04_ndcg", "ndcg", "round(coalesce(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 1), 6)"),
):

    @register(_key, f"WITH {MANY} SELECT query, {_sql} AS {_name} FROM q")
    def _(spark, folder, name=_name):
        return _measured(spark, folder).select("query", (F.col(name) if name == "hit" else F.round(name, 6)).alias(name))


@register("e12_multiset_equal", "SELECT true AS same, false AS other")
def _(spark, folder):
    docs = _docs(spark, folder).select("lang", "source")
    return spark.createDataFrame([(evaluate.same_rows(docs, docs.select("lang", "source")), evaluate.same_rows(docs, docs.distinct()))], "same boolean, other boolean")


@register("l09_rate_limiter")
def _(spark, folder):
    return admitted(spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias("client"), F.col("ts"), F.col("event_id").alias("id")), limit=3, seconds=3600)


@register("l07_verify_citations", "SELECT doc_id AS id, len(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text || ' [' || doc_id % 9 || ' , 3] [7]', '\\[(\\d+(\\s*,\\s*\\d+)*)\\]', 1), lambda m: string_split(m, ','))), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x BETWEEN 1 AND 6))) AS valid FROM documents")
def _(spark, folder):
    from citelake.operators.assist import cited

    answer = F.concat("text", F.lit(" ["), (F.col("id") % 9).cast("string"), F.lit(" , 3] [7]"))
    return _docs(spark, folder).select("id", F.size(cited(answer, F.lit(6))).cast("long").alias("valid"))


@register("j01_clean_text", "SELECT page_id, trim(regexp_replace(regexp_replace(url || ' <b>x</b>  y ', '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM pages")
def _(spark, folder):
    from citelake.functions.normalize import strip_tags

    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", strip_tags(F.concat("url", F.lit(" <b>x</b>  y "))).alias("clean"))


@register("j01_clean_html")
def _(spark, folder):
    """All of each page; DuckDB cannot resolve entities, so the tests hold it against brute force."""
    from citelake.functions.normalize import clean_text

    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", clean_text(F.col("html")).alias("clean"))
