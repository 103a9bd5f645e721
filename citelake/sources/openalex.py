"""Scholarly records from nested JSON pages, flattened by one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions import normalize as nz

# Field names of the public API, and its kinds of venues as the graph calls them.
VENUES = {"journal": "journal", "conference": "conference", "repository": "repository", "book series": "book", "ebook platform": "book"}
SCHEMA = """meta struct<count:bigint,per_page:int,next_cursor:string>, results array<struct<
id:string,doi:string,title:string,display_name:string,publication_year:int,publication_date:string,language:string,type:string,cited_by_count:bigint,
abstract_inverted_index:map<string,array<int>>,
authorships:array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,ror:string,country_code:string>>,raw_author_name:string>>,
primary_location:struct<landing_page_url:string,source:struct<id:string,display_name:string,type:string>>,locations:array<struct<landing_page_url:string,pdf_url:string>>,
topics:array<struct<id:string,display_name:string,score:double>>,keywords:array<struct<id:string,display_name:string,score:double>>,referenced_works:array<string>,ids:map<string,string>>>"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per work of JSON page files."""
    return spark.read.schema(SCHEMA.replace("\n", "")).option("multiLine", True).json(path).select(F.explode("results").alias("work"))


def works(spark: SparkSession, payload: DataFrame) -> DataFrame:
    """One row per work of a column ``payload`` of JSON pages."""
    return payload.select(F.from_json("payload", f"struct<{_ddl()}>").alias("page")).select(F.explode("page.results").alias("work"))


def _ddl() -> str:
    """The schema as fields of a struct type."""
    return SCHEMA.replace("\n", "").replace("meta struct", "meta:struct", 1).replace(", results array", ",results:array", 1)


def short_id(c):
    return F.nullif(F.regexp_extract(c, r"([A-Z]\d+)$", 1), F.lit(""))


def records(works_: DataFrame) -> DataFrame:
    """Normalised papers: identifiers, title (display name if missing), abstract, authors with names, venue, references."""
    w = F.col("work")
    name = lambda a: F.coalesce(a["author"]["display_name"], a["raw_author_name"])
    found = F.filter(F.transform(F.coalesce(w["locations"], F.array()), lambda x: F.coalesce(nz.arxiv_id(F.regexp_extract(F.coalesce(x["landing_page_url"], F.lit("")), r"arxiv\.org/(?:abs|pdf)/(.*)", 1)), nz.arxiv_id(F.regexp_extract(F.coalesce(x["pdf_url"], F.lit("")), r"arxiv\.org/(?:abs|pdf)/(.*)", 1)))), lambda x: x.isNotNull())
    doi = nz.doi(w["doi"])
    return works_.select(
        short_id(w["id"]).alias("openalex_id"), doi.alias("doi"),
        F.coalesce(nz.arxiv_id(F.regexp_extract(F.coalesce(doi, F.lit("")), r"10\.48550/arxiv\.(.*)", 1)), F.get(found, 0)).alias("arxiv_id"),
        nz.clean_text(F.coalesce(w["title"], w["display_name"])).alias("title"), nz.rebuild_abstract(w["abstract_inverted_index"]).alias("abstract"),
        w["publication_year"].alias("year"), F.try_to_date(w["publication_date"]).alias("publication_date"),
        w["cited_by_count"].alias("citation_count"), w["primary_location"]["source"]["display_name"].alias("venue"),
        F.when(w["primary_location"]["source"].isNotNull(), F.coalesce(F.create_map(*(F.lit(v) for kv in VENUES.items() for v in kv))[w["primary_location"]["source"]["type"]], F.lit("other"))).alias("venue_type"),
        F.coalesce(w["primary_location"]["landing_page_url"], F.concat(F.lit("https://doi.org/"), doi)).alias("url"), w["language"].alias("language"),
        F.transform(F.coalesce(w["topics"], F.expr("array()")), lambda t: t["display_name"]).alias("topics"),
        F.transform(F.coalesce(w["keywords"], F.expr("array()")), lambda t: t["display_name"]).alias("keywords"),
        F.transform(F.filter(F.coalesce(w["authorships"], F.array()), lambda a: F.length(F.trim(name(a))) > 0), lambda a: F.struct(name(a).alias("name"), short_id(a["author"]["id"]).alias("openalex_id"), nz.orcid(a["author"]["orcid"]).alias("orcid"))).alias("authors"),
        F.filter(F.transform(F.coalesce(w["referenced_works"], F.array()), short_id), lambda x: x.isNotNull()).alias("references"),
    )


def load_records(rows: DataFrame) -> DataFrame:
    """Rows of ``records`` as a batch to load, in the order of their ids."""
    from pyspark.sql import Window

    none = lambda kind: F.lit(None).cast(kind)
    people = F.transform("authors", lambda a: F.struct(a["name"].alias("name"), none("string").alias("key"), a["orcid"].alias("orcid"), a["openalex_id"].alias("openalex_id")))
    # one batch job's records in one order: a load is sequential over its batches
    place = (F.row_number().over(Window.orderBy("openalex_id", "title")) - 1).cast("bigint")
    return rows.select(
        place.alias("id"), place.alias("place"), F.lit("openalex").alias("source"), "doi", "openalex_id", "arxiv_id", none("string").alias("s2_id"), none("string").alias("seed_key"), "title", "abstract",
        none("string").alias("description"), "year", "publication_date", "language", "url", "citation_count", "venue", people.alias("people"), "topics", "keywords",
        F.transform("references", lambda r: F.concat(F.lit("openalex_id="), r)).alias("references"),
    )
