"""The thin opN queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import bpe, decontaminate, exact_dedup, html_text, near_dedup, pii, quality, suffix_dedup, token_count, toxicity
from citelake.llm.labels import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode(docs, path, decoded="decoded")
    return made.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
     b AS (SELECT item_id, len(l) AS n, unnest(l) AS s FROM (SELECT item_id, {_SHINGLES} AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.75 * n
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(_table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, {_SHINGLES} AS l FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
     s AS (SELECT doc_id, len(l) AS n, unnest(l) AS s FROM l),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
     e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
     r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
     c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c JOIN l USING (doc_id)
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.budgeted(docs, tokenizer_path("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return made.select("doc_id", (fold("doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction, "op2_suffix_dedup": op2_suffix_dedup, "op3_bpe": op3_bpe, "op4_exact_dedup": op4_exact_dedup, "op5_quality": op5_quality, "op6_decontamination": op6_decontamination,
        "op7_near_dedup": op7_near_dedup, "op8_token_counts": op8_token_counts, "op9_pii": op9_pii, "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_decontamination": OP6_SQL, "op7_near_dedup": OP7_SQL}
