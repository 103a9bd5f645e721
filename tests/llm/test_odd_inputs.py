"""Every corpus operator and pipeline stage on odd input: nulls, empty and long texts, ties, repeated rows, empty tables and
columns whose names clash with the operators' own; and the classifiers against plain formulas."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import bpe, decontaminate, exact_dedup, html_text, near_dedup, pii, quality, queries, suffix_dedup, token_count, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASH = ["id", "h", "c", "s", "digest", "keep_id", "kept", "component", "score", "label", "_digest", "_keep_id", "_sha", "_rank", "_spans", "_gone", "_n", "a.b", "base", "spans"]
TEXTS = [None, "", " ", "one", "a b c d e", "A B c d e", "x" * 30_000, "word " * 8_000, "mail a.b@x.org", "<p>x", "tie " * 60, "tie " * 60]


def _docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    return made.select("doc_id", "text", *(F.lit(c).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return _docs(spark, [*rows, (3, "one"), (3, "one"), (None, "no id"), (None, None), (None, "tie " * 60)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e"), (None, "tie tie tie tie tie"), (3, None), (4, "")], "item_id int, text string")


def _path():
    return queries.tokenizer_path("byte_bpe_50k.json")


KEEPERS = {
    "toxicity": lambda docs, labels, items: toxicity.keep(docs, labels), "exact_dedup": lambda docs, labels, items: exact_dedup.keep(docs),
    "near_dedup": lambda docs, labels, items: near_dedup.keep(docs), "decontamination": lambda docs, labels, items: decontaminate.keep(docs, items),
    "pii": lambda docs, labels, items: pii.sanitize(docs, pii.find(docs)),
}
MARKERS = {
    "html": lambda docs, labels, items: html_text.extract(docs, "text", "shown"), "suffix": lambda docs, labels, items: suffix_dedup.remove_repeats(docs),
    "bpe": lambda docs, labels, items: bpe.encode(docs, _path(), decoded="decoded"), "exact": lambda docs, labels, items: exact_dedup.mark(docs),
    "quality": lambda docs, labels, items: quality.score(docs, labels), "near": lambda docs, labels, items: near_dedup.mark(docs),
    "counts": lambda docs, labels, items: token_count.budgeted(docs, queries.tokenizer_path("piece_bpe_32k.model")),
    "pii": lambda docs, labels, items: pii.report(docs), "toxicity": lambda docs, labels, items: toxicity.score(docs, toxicity.train(docs, labels), out="toxic"),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_keepers_pass_rows_and_columns_through(odd, labels, items, name):
    got = KEEPERS[name](odd, labels, items)
    assert got.columns == odd.columns
    rows = got.collect()
    assert rows and all(r[c] == c for r in rows for c in CLASH)
    if name == "exact_dedup":
        assert sorted(str(r["text"]) for r in rows if r["text"]) == sorted({str(t) for t in TEXTS if t} | {"no id"})
    if name == "decontamination":
        assert not {4, 5} & {r["doc_id"] for r in rows} and {6, 7} <= {r["doc_id"] for r in rows} | {7}
    assert KEEPERS[name](odd.limit(0), labels, items).count() == 0


@pytest.mark.parametrize("name", MARKERS)
def test_markers_return_a_row_for_each_row(odd, labels, items, name):
    assert MARKERS[name](odd, labels, items).count() == odd.count()
    assert MARKERS[name](odd.limit(0), labels, items).count() == 0


def test_search_takes_any_id(odd, items):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(odd, items).collect()}
    assert got == {(4, 1), (5, 1), (10, None), (11, None), (None, None)}
    named = items.select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("item_id"), "text")
    assert ("i1" in {r["item_id"] for r in decontaminate.search(odd, named).collect()}) and decontaminate.search(odd, items.limit(0)).count() == 0


def test_repeated_rows_do_not_multiply(spark):
    passage = " ".join(f"w{k}" for k in range(80))
    docs = _docs(spark, [(1, passage)] * 30 + [(None, passage)] * 20 + [(2, "alone " + passage[:100])])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == 51 and sum(r["n_removed"] == len(passage) for r in got) == 50


def test_stages_on_odd_input(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, str(tmp_path))
        assert got.count() > 0, name
        assert name == "bpe" or got.columns == odd.columns
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_factorization_machine_against_explicit_pairs():
    rng = np.random.default_rng(3)
    params = rng.normal(size=(9, 1 + toxicity.FACTORS)).astype(np.float32)
    texts = [[0, 3, 5], [1], [2, 4, 6, 8], [7, 8]]
    start = np.cumsum([0, *map(len, texts)])[:-1]
    got = toxicity._raw(params[np.concatenate(texts)], start)[0]
    for k, own in enumerate(texts):
        pairs = sum(float(params[i, 1:] @ params[j, 1:]) for n, i in enumerate(own) for j in own[:n])
        assert abs(got[k] - (params[own, 0].sum() + pairs)) < 1e-4


def test_quadratic_discriminant_against_dense_densities(spark):
    rng = random.Random(5)
    words = "the of and to in house tree water river stone cloud".split()
    texts = [" ".join(rng.choice(words) + ("!!" if i % 3 == 0 else "") for _ in range(rng.randrange(20, 80))) for i in range(300)]
    rows = quality.featurise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = rows.withColumn("label", (F.col("doc_id") % 3 != 0).cast("bigint"))
    model = quality.train(rows)
    data = rows.orderBy("doc_id").collect()
    x, y = np.array([r["stats"] for r in data]), np.array([r["label"] for r in data])
    z = (x - x.mean(0)) / np.sqrt(np.maximum(x.var(0), 1e-12))
    logs = []
    for k in (0, 1):
        own, d = z[y == k], z.shape[1]
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        off = z - own.mean(0)
        logs.append(np.log(len(own) / len(z)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -35, 35)))
    assert np.abs(model.scores(x) - want).max() < 1e-6


def test_pii_terms_against_counts(spark):
    rng = random.Random(11)
    names = ["Quentinson", "Abernathy", "Zebulonia", "ordinary", "padding"]
    texts = []
    for i in range(120):
        who = rng.choice(["boss@corp.example", "aide@corp.example", "", ""])
        tell = ["Quentinson"] if who.startswith("boss") else ["Abernathy"] if who and rng.random() < 0.5 else []
        texts.append(" ".join([*rng.sample(names[3:], 1), f"no{i}", *tell, who, rng.choice(names[2:])]).strip())
    import re

    n = len(texts)
    said = [{w.lower() for w in re.findall(r"(?<!\S)[^\W\d_]{4,}(?![^\s.,;:!?])", t)} for t in texts]
    held = [set(re.findall(r"\w+@corp\.example", t)) for t in texts]
    want = [set() for _ in texts]
    for e in {e for h in held for e in h}:
        de = sum(e in h for h in held)
        for w in set().union(*said):
            df, both = sum(w in s for s in said), sum(w in s and e in h for s, h in zip(said, held, strict=True))
            if min(de, df, both) >= pii.MIN_JOINT and np.log2(n * both / (df * de)) >= pii.ALPHA * np.log2(n / de):
                for k in range(n):
                    if e in held[k] and w in said[k]:
                        want[k].add(w)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: {t["value"] for t in r["terms"]} for r in pii.find(docs).collect()}
    assert [got[k] for k in range(n)] == want and any(want)
