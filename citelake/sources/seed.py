"""Seed datasets of papers in one JSON file, with integrity checks that return the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """dataset string, version int, topics array<struct<key:string,name:string,description:string>>, venues array<struct<key:string,name:string,type:string>>,
papers array<struct<key:string,title:string,year:int,arxiv:string,venue:string,authors:array<struct<name:string,key:string>>,topics:array<string>,keywords:array<string>,description:string,cites:array<string>>>"""


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA.replace("\n", " ")).option("multiLine", True).json(path)


def papers(data: DataFrame) -> DataFrame:
    return data.select(F.explode("papers").alias("p")).select("p.*")


def citations(data: DataFrame) -> DataFrame:
    return papers(data).select(F.col("key").alias("src"), F.explode("cites").alias("dst"))


def problems(data: DataFrame) -> DataFrame:
    """(rule, key): repeated keys, unknown venues and topics, citations that are missing, of itself or of a later year."""
    own = papers(data)
    known = lambda kind: data.select(F.explode(kind).alias("x")).select(F.col("x.key").alias("k"))
    say = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
    years = own.select(F.col("key").alias("dst"), F.col("year").alias("cited_year"))
    links = own.select(F.col("key").alias("src"), "year", F.explode("cites").alias("dst")).join(years, "dst", "left")
    parts = [
        say(own.groupBy("key").count().where("count > 1"), "repeated key", "key"),
        say(own.where("venue IS NOT NULL").join(known("venues").withColumnRenamed("k", "venue"), "venue", "left_anti"), "unknown venue", "key"),
        say(own.select("key", F.explode("topics").alias("k")).join(known("topics"), "k", "left_anti"), "unknown topic", "key"),
        say(links.join(own.select(F.col("key").alias("dst")), "dst", "left_anti"), "unknown citation", "src"),
        say(links.where("src = dst"), "cites itself", "src"), say(links.where("cited_year > year"), "cites a later paper", "src"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
