"""Loading a batch of records into the tables of the graph: duplicates, resolution, papers, authors, vocabulary, citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions import normalize as nz
from citelake.operators import ingest, resolve
from citelake.operators.algorithms import checkpointed, forget, stored
from citelake.operators.ingest import IDENTIFIERS

SCALARS = (*IDENTIFIERS, "title", "title_key", "abstract", "description", "year", "publication_date", "language", "url", "citation_count", "venue")
LISTS = ("topics", "keywords", "references")
PERSON = "struct<name:string,key:string,orcid:string,openalex_id:string>"
RECORD = (
    "id bigint, place bigint, source string, doi string, openalex_id string, arxiv_id string, s2_id string, seed_key string, title string, abstract string, "
    f"description string, year int, publication_date date, language string, url string, citation_count bigint, venue string, people array<{PERSON}>, "
    "topics array<string>, keywords array<string>, references array<string>"
)
PAPER_FIRST = ("title", "title_key", "description", "year", "publication_date", "url", "language", *IDENTIFIERS)
PAPER = "id string, is_stub boolean, sources array<string>, abstract string, citation_count bigint, title string, title_key string, description string, year int, publication_date date, url string, language string, doi string, openalex_id string, arxiv_id string, s2_id string, seed_key string"
AUTHOR = "id string, name string, name_key string, orcid string, openalex_id string"
EDGE = "src string, dst string, source string"


def upsert_authors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Authors by id; what is known stays."""
    return ingest.upsert(old, new, "id", first=("name", "name_key", "orcid", "openalex_id"))


def upsert_edges(old: DataFrame, new: DataFrame, properties: tuple[str, ...] = ("source",)) -> DataFrame:
    """Links (src, dst, properties); of a link that is there the given properties change, nulls change nothing."""
    return ingest.upsert(old, new, ["src", "dst"], last=properties)


def insert_stubs(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """papers with a stub for each new target of resolved references (dst, kind, value, is_new)."""
    fresh = refs.where("is_new").groupBy(F.col("dst").alias("id")).agg(F.first("kind").alias("kind"), F.min("value").alias("value"))
    made = fresh.join(papers.select("id"), "id", "left_anti").select("id", F.lit(True).alias("is_stub"), *(F.when(F.col("kind") == k, F.col("value")).alias(k) for k in IDENTIFIERS))
    return papers.unionByName(made, allowMissingColumns=True)


def resolve_references(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst, kind, value, is_new) of references (src, ref, kind, value): the owner of the strongest identifier that is
    known, else one stub for each distinct reference; a paper that refers to itself does not.

    A reference ``ref`` may have several identifiers; owners: (kind, value, id).
    """
    order = F.array_position(F.array(*map(F.lit, IDENTIFIERS)), F.col("kind"))
    known = refs.join(owners, ["kind", "value"], "left").withColumn("rank", order)
    best = F.min(F.when(F.col("id").isNotNull(), F.struct("rank", "id")))["id"].alias("owner")
    told = known.groupBy("src", "ref").agg(best, F.min(F.struct("rank", "kind", "value")).alias("m"))
    stub = F.concat(F.lit("paper:stub:"), F.substring(F.sha2(F.concat_ws("=", "m.kind", "m.value").cast("binary"), 256), 1, 16))
    made = told.select("src", F.coalesce("owner", stub).alias("dst"), "m.kind", "m.value", F.col("owner").isNull().alias("is_new"))
    return made.where("src <> dst").dropDuplicates(["src", "dst"])


def merge_papers(tables: dict[str, DataFrame], merges: DataFrame) -> dict[str, DataFrame]:
    """Papers ``old`` become ``kept`` in all tables: links move with their properties over those that are there, loops go,
    columns of the paper that stays come first, a paper is a stub only if both were, sources join."""
    out = dict(tables)
    to = merges.select(F.col("old").alias("_old"), F.col("kept").alias("_kept"))
    papers = tables["paper"]
    named = papers.join(to, F.col("id") == F.col("_old"), "left").withColumn("own", F.col("_old").isNull())
    first = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("own", (-F.xxhash64("id")).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    plain = [c for c in papers.columns if c not in ("id", "is_stub", "sources")]
    made = named.groupBy(F.coalesce("_kept", "id").alias("id")).agg(
        F.min(F.coalesce("is_stub", F.lit(False))).alias("is_stub"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", F.array()))))).alias("sources"),
        F.array_sort(F.collect_set(F.when(~F.col("own"), F.col("id")))).alias("merged_ids"), *map(first, plain),
    )
    out["paper"] = made
    for name, rows in tables.items():
        if name == "paper":
            continue
        ends = [c for c, t in (("src", "paper"), ("dst", "paper")) if name == "cites" or (name == "wrote") == (c == "dst")]
        moved, hit = rows, F.lit(False)
        for c in ends:
            key = to.select(F.col("_old").alias(c), F.col("_kept").alias(f"_{c}"))
            moved = moved.join(key, c, "left")
            hit = hit | F.col(f"_{c}").isNotNull()
        moved = moved.withColumn("_hit", hit)
        for c in ends:
            moved = moved.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        rest = [c for c in rows.columns if c not in ("src", "dst")]
        laid = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_hit", F.col(c).alias("v"))))["v"].alias(c)
        moved = moved.where("src <> dst")
        out[name] = moved.groupBy("src", "dst").agg(*map(laid, rest)) if rest else moved.select("src", "dst").distinct()
    return out


def vocabulary(records: DataFrame) -> dict[str, DataFrame]:
    """Links (src, dst, source) of papers to venues, topics and keywords, and these as (id, name); names without letters or
    digits make none. records: paper, source, venue, topics, keywords."""
    out = {}
    for kind, column, link in (("venue", F.array("venue"), "published_in"), ("topic", F.col("topics"), "has_topic"), ("keyword", F.col("keywords"), "has_keyword")):
        names = records.select(F.col("paper").alias("src"), "source", F.explode(column).alias("name")).where("name IS NOT NULL")
        told = names.withColumn("slug", nz.slug(F.col("name"))).where("slug <> ''").withColumn("dst", F.concat(F.lit(f"{kind}:"), "slug"))
        out[link] = told.groupBy("src", "dst").agg(F.max("source").alias("source"))
        out[kind] = told.groupBy(F.col("dst").alias("id")).agg(F.min("name").alias("name"))
    return out


@dataclass
class Loaded:
    tables: dict[str, DataFrame]
    counts: dict[str, int]


def empty(spark) -> dict[str, DataFrame]:
    make = lambda schema: spark.createDataFrame([], schema)
    tables = {"paper": make(PAPER), "author": make(AUTHOR), "cites": make(EDGE), "wrote": make("src string, dst string, position int, source string")}
    return tables | {k: make(EDGE) for k in ("published_in", "has_topic", "has_keyword")} | {k: make("id string, name string") for k in ("venue", "topic", "keyword")}


def _paper_id(row: Column) -> Column:
    """A deterministic id of a new paper from its strongest identifier, else its title and first record."""
    strongest = F.coalesce(*(F.concat(F.lit(f"{k}="), F.col(k)) for k in IDENTIFIERS), F.concat_ws("=", F.lit("title"), "title_key", F.col("id").cast("string")))
    return F.concat(F.lit("paper:"), F.substring(F.sha2(strongest.cast("binary"), 256), 1, 24))


def load_batch(tables: dict[str, DataFrame], records: DataFrame) -> Loaded:
    """One batch of RECORD rows, in the order of ``place``: duplicates in it are folded, papers resolved against the graph,
    merged where one record names several, then papers, authors, vocabulary and citations are written."""
    spark = records.sparkSession
    rows = records.withColumn("title_key", nz.title_key(F.col("title")))
    rows = stored(rows.withColumn("authors", nz.author_keys(F.col("people"))))
    received = rows.count()
    keep = checkpointed(resolve.dedupe_batch(rows))
    folded = resolve.merge_records(rows.join(keep, "id").withColumnRenamed("id", "record"), "keep", "place", (*SCALARS, "source"), LISTS, "people")
    folded = stored(folded.withColumnRenamed("keep", "id").withColumn("authors", nz.author_keys(F.col("people"))))
    kept = folded.count()
    forget(rows)
    papers = tables["paper"]
    names = tables["wrote"].join(tables["author"].select(F.col("id").alias("src"), "name"), "src").groupBy(F.col("dst").alias("id")).agg(nz.author_keys_of_names(F.collect_set("name")).alias("authors"))
    nodes = stored(papers.join(names, "id", "left"))
    told = checkpointed(resolve.resolve(folded.withColumn("id", F.col("id").cast("string")), nodes))
    matched = resolve.match_identifiers(folded.withColumn("id", F.col("id").cast("string")), nodes)
    merges = checkpointed(matched.select(F.col("node").alias("kept"), F.explode("merge_ids").alias("old")).groupBy("old").agg(F.min("kept").alias("kept")).where("old <> kept"))
    conflicts = matched.select(F.sum(F.size("conflicts"))).first()[0] or 0
    if not merges.isEmpty():
        tables = tables | {k: stored(v) for k, v in merge_papers({k: tables[k] for k in ("paper", "cites", "wrote", "published_in", "has_topic", "has_keyword")}, merges).items()}
    placed = folded.join(told.select(F.col("record").cast("bigint").alias("id"), "node", "reason"), "id")
    placed = placed.withColumn("paper", F.coalesce("node", _paper_id(F.col("id"))))
    placed = stored(resolve.drop_owned(placed.withColumn("node", F.col("paper")), tables["paper"]))
    forget(folded)
    forget(nodes)
    new = placed.select(F.col("paper").alias("id"), F.lit(False).alias("is_stub"), F.array("source").alias("sources"), "abstract", "citation_count", *PAPER_FIRST)
    old = tables["paper"].select("id", "is_stub", "sources", "abstract", "citation_count", *PAPER_FIRST)
    merged = ingest.upsert(old, new, "id", first=PAPER_FIRST, last=("abstract", "citation_count"), union=("sources",))
    stub = old.select("id", F.col("is_stub").alias("was")).join(new.select("id").distinct().withColumn("given", F.lit(True)), "id", "full")
    written = merged.join(stub, "id").withColumn("is_stub", F.when(F.col("given"), False).otherwise(F.coalesce("was", F.lit(False)))).drop("was", "given")
    people = stored(_authors(tables, placed))
    authors = upsert_authors(tables["author"], people.select(F.col("author").alias("id"), "name", "name_key", "orcid", "openalex_id"))
    wrote = upsert_edges(tables["wrote"], people.select(F.col("author").alias("src"), F.col("paper").alias("dst"), "position", "source"), ("position", "source"))
    words = vocabulary(placed)
    owners = resolve.long_ids(written, "owner").select("kind", "value", F.col("owner").alias("id")).groupBy("kind", "value").agg(F.min("id").alias("id"))
    # a reference is an identifier with its kind before it, as in doi=10.1/x
    refs = placed.select(F.col("paper").alias("src"), F.explode("references").alias("ref")).select("src", "ref", F.split("ref", "=", 2).alias("p")).select("src", "ref", F.get("p", 0).alias("kind"), F.get("p", 1).alias("value")).where("value IS NOT NULL")
    links = stored(resolve_references(refs, owners))
    with_stubs = stored(insert_stubs(written, links))
    cites = upsert_edges(tables["cites"], links.select("src", "dst", F.lit("batch").alias("source")))
    out = tables | {"paper": with_stubs, "author": stored(authors), "wrote": stored(wrote), "cites": stored(cites)}
    forget(people)
    for name, made in words.items():
        out[name] = stored(upsert_edges(tables[name], made) if "src" in made.columns else ingest.upsert(tables[name], made, "id", first=("name",)))
    counts = {
        "received": received, "duplicates_in_batch": received - kept, "papers_created": placed.where("reason = 'new'").count(), "papers_matched": placed.where("reason <> 'new'").count(),
        "papers_merged": merges.count(), "id_conflicts": conflicts, "authors_created": out["author"].count() - tables["author"].count(),
        "citations": links.count(), "stubs_created": links.where("is_new").select("dst").distinct().count(),
    }
    forget(placed)
    forget(links)
    return Loaded(out, counts)


def _authors(tables: dict[str, DataFrame], placed: DataFrame) -> DataFrame:
    """(paper, author, position, source, name, name_key, orcid, openalex_id) of every mention with a name."""
    said = placed.select("paper", "source", F.posexplode("people").alias("position", "p")).select("paper", "source", "position", "p.*").where(F.length(F.trim("name")) > 0)
    said = said.withColumn("name_key", nz.name_key(F.col("name"))).withColumn("id", F.xxhash64("paper", "position", "name_key"))
    with_all = said.groupBy("paper").agg(F.array_sort(F.collect_set("name_key")).alias("coauthors"))
    said = stored(said.join(with_all, "paper"))
    others = tables["wrote"].select("src", "dst").join(tables["author"].select(F.col("id").alias("src"), "name_key"), "src")
    of_paper = others.groupBy("dst").agg(F.collect_set("name_key").alias("all"))
    own = others.select("src", "dst").join(of_paper, "dst").groupBy(F.col("src").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("all"))).alias("coauthors"))
    nodes = tables["author"].join(own, "id", "left").withColumn("coauthors", F.coalesce("coauthors", F.array().cast("array<string>")))
    known = resolve.resolve_authors(said, nodes)
    new = said.join(known.where("node IS NULL").select(F.col("author").alias("id")), "id", "left_semi")
    clusters = resolve.cluster_mentions(new.select("id", "paper", "name_key", "coauthors", "key", "orcid", "openalex_id"))
    named = F.coalesce(F.concat(F.lit("author:"), F.col("key")), "node", F.concat(F.lit("author:"), F.hex("cluster")))
    made = said.join(known.select(F.col("author").alias("id"), "node"), "id").join(clusters.withColumnRenamed("author", "cluster"), "id", "left")
    # an author has the id of its key if it has one, so a mention that is new under a key keeps it
    made = made.withColumn("author", F.when(F.col("node").isNotNull(), F.col("node")).otherwise(named))
    best = F.min(F.struct("position", "source", "name", "name_key", "orcid", "openalex_id")).alias("m")
    return made.groupBy("paper", "author").agg(best).select("paper", "author", "m.*")


def load(tables: dict[str, DataFrame], records: DataFrame, size: int = 50) -> Loaded:
    """All records in batches by ``place``; the counts of the batches add up. The loop is one over batches, not rows."""
    total: dict[str, int] = {}
    last = records.agg(F.max("place")).first()[0]
    for k in range(0, (last if last is not None else -1) + 1, size):
        done = load_batch(tables, records.where((F.col("place") >= k) & (F.col("place") < k + size)))
        tables = done.tables
        total = {c: total.get(c, 0) + n for c, n in done.counts.items()}
    return Loaded(tables, total)


def from_seed(data: DataFrame) -> DataFrame:
    """RECORD rows of a seed dataset: references by seed key, and by arXiv id where the cited paper has one."""
    own = data.select(F.posexplode("papers").alias("place", "p")).select(F.col("place").cast("bigint").alias("place"), "p.*")
    cited = own.select(F.col("key").alias("cite"), F.col("arxiv").alias("their"))
    refs = own.select("key", F.explode("cites").alias("cite")).join(cited, "cite", "left")
    refs = refs.groupBy("key").agg(F.array_sort(F.collect_set(F.concat(F.lit("seed_key="), "cite"))).alias("references"))
    words = data.select(F.explode("topics").alias("t")).select(F.col("t.key").alias("topic"), F.col("t.name").alias("name"))
    said = own.select("key", F.explode("topics").alias("topic")).join(words, "topic").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("topic_names"))
    places = data.select(F.explode("venues").alias("v")).select(F.col("v.key").alias("venue"), F.col("v.name").alias("venue_name"))
    made = own.join(refs, "key", "left").join(said, "key", "left").join(places, "venue", "left")
    person = F.transform("authors", lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["key"], nz.plain_slug(a["name"])).alias("key"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("openalex_id")))
    none = lambda kind: F.lit(None).cast(kind)
    return made.select(
        F.col("place").alias("id"), "place", F.lit("seed").alias("source"), none("string").alias("doi"), none("string").alias("openalex_id"), nz.arxiv_id(F.col("arxiv")).alias("arxiv_id"),
        none("string").alias("s2_id"), F.col("key").alias("seed_key"), "title", none("string").alias("abstract"), "description", "year", none("date").alias("publication_date"),
        none("string").alias("language"), none("string").alias("url"), none("bigint").alias("citation_count"), F.col("venue_name").alias("venue"), person.alias("people"),
        F.col("topic_names").alias("topics"), "keywords", "references",
    )
