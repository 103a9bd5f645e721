"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find the protected entities (e-mail, IP, card and phone numbers). Corpus co-occurrence then estimates how
strongly the terms of a text reveal an entity in it: with document frequencies over all N whole texts, a term t
discloses an entity e when PMI(t, e) = log2(N df(t, e) / (df(t) df(e))) reaches ALPHA times the entity's information
content log2(N / df(e)), seen in at least MIN_JOINT documents. In the documents that hold the entity every occurrence of
a disclosing term outside entities becomes a span of kind ``term``; ``sanitize`` generalises entities and terms to their
kind.

Offsets count code points, ends are exclusive. Terms are runs of four or more letters between white space or the start
of the text and white space, punctuation or its end, lower-cased.

Defined results: a null or empty text has no spans and hash of the empty string; rows that repeat an id are counted and
returned each; null ids stay; digit runs, separators or names of any length are matched without recursion; extra
columns pass through ``sanitize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import column, cut, fresh_name

# What the four kinds look like. Possessive quantifiers and the look at the character before change no
# match but keep the search linear and free of recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM_START, TERM_END = r"(?<!\S)", r"(?![^\s.,;:!?])"
TERM = rf"{TERM_START}\p{{L}}{{4,}}+{TERM_END}"
ALPHA = 0.9
MIN_JOINT = 3


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of all matches, from the lengths of what lies between them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["value"])
        return F.struct(b.alias("at"), F.concat(acc["all"], F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value")))).alias("all"))

    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(zipped, start, step, lambda acc: acc["all"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    turned = F.reverse(_digits(value))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(turned) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid spans of the four kinds by start, then kind."""
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def of(rank: int, kind: str) -> Column:
        kept = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        made = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
        return F.when(sign.get(kind, text.rlike("[0-9]")), made).otherwise(empty)

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    """The distinct terms of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _lowered(terms: Column) -> Column:
    return F.array_distinct(F.transform(terms, F.lower))


def _term_spans(text: Column, terms: Column) -> Column:
    """Every occurrence in a text of the given terms, in any case."""
    written = F.filter(_terms(text), lambda w: F.array_contains(terms, F.lower(w)))
    pattern = F.concat(F.lit(f"{TERM_START}(?:"), F.array_join(written, "|"), F.lit(f"){TERM_END}"))
    return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), m["end"].alias("end"), F.lit("term").alias("kind"), F.lower(m["value"]).alias("value")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_joint: int = MIN_JOINT) -> DataFrame:
    """One row per document: doc_id, base and terms, arrays of struct<start, rank, end, kind, value>."""
    text = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    based = text.withColumn("base", base_spans(F.col("text")))
    # texts without an entity can have no spans of terms and stay behind
    rows = cut(based.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    n = rows.count()
    named = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    mention = rows.select("row", F.explode(named).alias("entity"))
    entity = cut(mention.groupBy("entity").agg(F.count("*").alias("de")).where(F.col("de") >= min_joint))
    most = entity.agg(F.max("de")).first()[0] or 0
    mention = cut(mention.join(entity, "entity"))
    pmi = lambda both: F.log2(F.lit(float(n)) * both / (F.col("df") * F.col("de")))
    least = alpha * F.log2(F.lit(float(n)) / F.col("de"))
    # a term is in a joint count at most df and at most de times: what no entity's bound lets through goes before the pairs
    bound = max(most, most**alpha * n ** (1 - alpha) * (1 + 1e-9))
    df = text.select(F.explode(_lowered(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_joint) & (F.col("df") <= bound))
    said = rows.join(mention.select("row").distinct(), "row", "left_semi").select("row", F.explode(_lowered(_terms(F.col("text")))).alias("term"))
    said = cut(said.join(df, "term"))
    pairs = said.join(mention, "row").where(pmi(F.least("df", "de")) >= least)
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("df").alias("df"), F.first("de").alias("de"))
    disclosing = joint.where((F.col("both") >= min_joint) & (pmi(F.col("both")) >= least)).select("entity", "term")
    told = pairs.join(disclosing, ["entity", "term"], "left_semi").groupBy("row").agg(F.collect_set("term").alias("told"))
    added = rows.join(told, "row").select("row", _term_spans(F.col("text"), F.col("told")).alias("terms"))
    clear = F.filter(F.coalesce("terms", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return rows.drop("text").join(added, "row", "left").select("doc_id", "base", F.array_sort(clear).alias("terms"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each kind, hash of the base spans, all spans."""
    made = find(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitize(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of its row in ``find`` generalised to its kind in brackets; overlapping spans merge into the first."""
    key, held = fresh_name("id"), fresh_name("spans")
    body = column(text_col)
    marks = spans.groupBy(F.col("doc_id").alias(key)).agg(F.first(F.array_sort(F.concat("base", "terms"))).alias(held))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(held, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.lit(2**31 - 1))))
    joined = docs.join(marks, column(id_col) == F.col(key), "left")
    return joined.withColumn(text_col, F.when(F.size(held) > 0, clean).otherwise(body)).drop(key, held)
