"""Paper sources: what one offers, pages behind cursors, retries, and a source over stored payloads of works."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.sources import openalex

# Answers that are worth another try, the longest wait, identifiers in one request.
RETRIED = frozenset({408, 425, 429, 500, 502, 503, 504})
MAX_WAIT, CHUNK = 60.0, 50


class PaperSource(Protocol):
    """Every method returns works (one struct column ``work``); closing frees what a source holds."""

    name: str

    def search(self, text: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame: ...
    def lookup(self, ids: list[str]) -> DataFrame: ...
    def get(self, work: str) -> DataFrame: ...
    def citing(self, work: str) -> DataFrame: ...
    def of_author(self, author: str) -> DataFrame: ...
    def references(self, work: str) -> DataFrame: ...
    def records(self, works: DataFrame) -> DataFrame: ...
    def close(self) -> None: ...


class StoredWorks:
    """A source over a table of works that were fetched before, such as ``openalex.read_pages``."""

    name = "stored"

    def __init__(self, works: DataFrame):
        self.works = works

    def _where(self, condition) -> DataFrame:
        return self.works.where(condition)

    def search(self, text: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        w = F.col("work")
        said = F.lower(F.coalesce(w["title"], w["display_name"], F.lit("")))
        ok = F.lit(True)
        for word in text.lower().split():
            ok = ok & F.contains(said, F.lit(word))
        if year_from is not None:
            ok = ok & (w["publication_year"] >= year_from)
        if year_to is not None:
            ok = ok & (w["publication_year"] <= year_to)
        return self._where(ok)

    def lookup(self, ids: list[str]) -> DataFrame:
        """Works by id or DOI; the ids are a small table, so their number has no bound."""
        asked = self.works.sparkSession.createDataFrame([(i.lower(),) for i in dict.fromkeys(ids)], "asked string")
        short, doi = F.lower(openalex.short_id(F.col("work.id"))), F.lower(F.regexp_replace("work.doi", "^https?://doi.org/", ""))
        keyed = self.works.withColumn("short", short).withColumn("asked", F.explode(F.array_distinct(F.array_compact(F.array(short, doi)))))
        return keyed.join(asked, "asked", "left_semi").drop("asked").dropDuplicates(["short"]).drop("short")

    def get(self, work: str) -> DataFrame:
        return self._where(openalex.short_id(F.col("work.id")) == work)

    def citing(self, work: str) -> DataFrame:
        return self._where(F.exists(F.coalesce("work.referenced_works", F.array().cast("array<string>")), lambda r: openalex.short_id(r) == work))

    def of_author(self, author: str) -> DataFrame:
        return self._where(F.exists(F.transform(F.coalesce("work.authorships", F.expr("array()")), lambda a: openalex.short_id(a["author"]["id"])), lambda i: i == author))

    def references(self, work: str) -> DataFrame:
        cited = self.get(work).select(F.explode("work.referenced_works").alias("r")).select(openalex.short_id(F.col("r")).alias("k")).distinct()
        return self.works.withColumn("k", openalex.short_id(F.col("work.id"))).join(cited, "k", "left_semi").drop("k")

    def records(self, works: DataFrame) -> DataFrame:
        return openalex.records(works)

    def close(self) -> None:
        self.works.unpersist()


def pages(fetch: Callable[[str | None], tuple[list, str | None]], most: int | None = None) -> Iterator[list]:
    """Pages of items behind cursors, until one is empty, there is no further cursor, or enough items came."""
    cursor, n = None, 0
    while True:
        items, cursor = fetch(cursor)
        if most is not None:
            items = items[: most - n]
        if not items:
            return
        yield items
        n += len(items)
        if cursor is None or most is not None and n >= most:
            return


def chunked(ids: list[str], size: int = CHUNK) -> list[list[str]]:
    return [ids[k : k + size] for k in range(0, len(ids), size)]


def patient(send: Callable[[], tuple[int, dict, object]], tries: int = 5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None):
    """The body of send() -> (status, headers, body); None for 404. Some states are tried again after Retry-After seconds, or
    after a time that doubles, with a random part."""
    rng = rng or random.Random()
    for k in range(tries):
        status, headers, body = send()
        if status < 300:
            return body
        if status == 404:
            return None
        if status not in RETRIED or k + 1 == tries:
            raise ConnectionError(f"status {status}")
        said = str(headers.get("Retry-After", ""))
        sleep(min(float(said) if said.replace(".", "", 1).isdigit() else 2**k * (0.5 + rng.random() / 2), MAX_WAIT))
    raise ConnectionError("no tries")


class Spaced:
    """Calls at least ``seconds`` apart."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, None

    def __call__(self) -> None:
        if self.last is not None and (left := self.last + self.seconds - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be loaded, and the others with the reason: no title, or a year or date that can't be."""
    late = (F.col("year") < 1000) | (F.col("year") > 2100)
    reason = F.when(F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0, "no title").when(late, "impossible year")
    told = records.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


REGISTRY: dict[str, Callable[..., PaperSource]] = {"stored": StoredWorks}
