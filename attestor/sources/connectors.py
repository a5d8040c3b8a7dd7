"""Catalogue services as a Spark data source: one partition for each request, payloads mapped by Column functions.

``spark.read.format("catalogue")`` gives (request_id, connector, status, payload, error). Its option ``fetcher`` names the
function that answers a request, as ``module:function``; it is called on the executors, with retries after growing pauses.
:func:`replay` answers from recorded payloads instead, which is the offline default.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from attestor.functions.identity import date_parts, identity_keys

SCHEMA = "request_id string, connector string, status string, payload string, error string"
# Answers after which a request is tried again; waits in seconds; when a host is spared and for how long.
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
FIRST_PAUSE, LONGEST_PAUSE, JITTER, SPACING = 1.0, 8.0, 0.25, 0.25
FAILURES, COOLDOWN = 3, 60.0
CACHE_HOURS = 24

Fetch = Callable[[str, str], str]


class HttpError(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def pause(attempt: int, jitter: float) -> float:
    """Seconds to wait after the ``attempt``-th try, from 1; ``jitter`` is 0 to 1."""
    base = min(FIRST_PAUSE * 2 ** (attempt - 1), LONGEST_PAUSE)
    return base * (1 + JITTER * jitter)


def fetch_with_retry(fetch: Fetch, connector: str, request: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer to a request; transient failures are tried again, all others raise at once."""
    for attempt in range(1, retries + 2):
        try:
            return fetch(connector, request)
        except (HttpError, TimeoutError, ConnectionError) as e:
            lasting = isinstance(e, HttpError) and e.status not in RETRY_STATUS
            if lasting or attempt > retries:
                raise
            sleep(pause(attempt, random.random()))
    raise AssertionError("unreachable")


def request_key(request: str) -> str:
    """The same for requests of the same content, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(json.loads(request), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def replay(requests: DataFrame, payloads: DataFrame) -> DataFrame:
    """Answers from recorded payloads (connector, key, payload) for (request_id, connector, key); a request without one has failed."""
    met = requests.join(payloads, ["connector", "key"], "left")
    known = F.col("payload").isNotNull()
    return met.select("request_id", "connector", F.when(known, "completed").otherwise("failed").alias("status"), "payload", F.when(~known, "no recorded payload").alias("error"))


class _Request(InputPartition):
    def __init__(self, request_id: str, connector: str, request: str) -> None:
        self.request_id, self.connector, self.request = request_id, connector, request


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.requests = [_Request(r["request_id"], r["connector"], json.dumps(r["request"])) for r in json.loads(options["requests"])]
        self.module, _, self.function = options["fetcher"].partition(":")

    def partitions(self) -> list[InputPartition]:
        return self.requests

    def read(self, part: _Request) -> Iterator[tuple]:
        try:
            fetch = getattr(importlib.import_module(self.module), self.function)
            yield part.request_id, part.connector, "completed", fetch_with_retry(fetch, part.connector, part.request), None
        except Exception as e:  # a failed request is a row of its own
            yield part.request_id, part.connector, "failed", None, f"{type(e).__name__}: {e}"[:300]


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def search(spark: SparkSession, requests: list[dict], fetcher: str) -> DataFrame:
    """Answers to (request_id, connector, request) dictionaries, one task for each."""
    spark.dataSource.register(CatalogueSource)
    return spark.read.format("catalogue").options(requests=json.dumps(requests), fetcher=fetcher).load()


def missing_requests(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests that the cache has no fresh answer for: (key, fetched_at) older than a day does not count."""
    fresh = cache.where(F.col("fetched_at") >= now - F.expr(f"INTERVAL {CACHE_HOURS} HOURS")).select("key").distinct()
    return requests.join(fresh, "key", "left_anti")


def _source(answer: DataFrame, provider: str, item: Column, **fields: Column) -> DataFrame:
    rows = answer.where(F.col("connector") == provider).select("request_id", F.explode(item).alias("i"))
    empty = {"title": "string", "url": "string", "doi": "string", "record": "string", "pdf_url": "string", "open_url": "string", "authors": "array<string>", "published": "string", "year": "int", "kind": "string", "description": "string"}
    columns = [fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in empty.items()]
    made = rows.select("request_id", F.lit(provider).alias("provider"), *columns)
    keys = identity_keys(F.lit(None).cast("string"), F.col("title"), F.col("url"), F.col("doi"), F.lit(None).cast("string"), F.col("record"), F.col("provider"), F.col("pdf_url"), F.col("open_url"), F.get("authors", F.lit(0)), F.col("year"))
    return made.withColumn("keys", keys)


def map_openalex(answers: DataFrame) -> DataFrame:
    """Works of OpenAlex as sources."""
    schema = "struct<results: array<struct<id: string, display_name: string, doi: string, publication_year: int, publication_date: string, authorships: array<struct<author: struct<display_name: string>>>, open_access: struct<oa_url: string>, primary_location: struct<pdf_url: string>>>>"
    i = F.col("i")
    return _source(
        answers, "openalex", F.from_json("payload", schema)["results"], title=i["display_name"], url=i["id"], doi=i["doi"], pdf_url=i["primary_location"]["pdf_url"], open_url=i["open_access"]["oa_url"],
        authors=F.transform(i["authorships"], lambda a: a["author"]["display_name"]), published=i["publication_date"], year=i["publication_year"], kind=F.lit("paper"),
    )


def map_crossref(answers: DataFrame) -> DataFrame:
    """Works of Crossref as sources; dates come in parts."""
    schema = "struct<message: struct<items: array<struct<DOI: string, URL: string, title: array<string>, author: array<struct<given: string, family: string>>, published: struct<`date-parts`: array<array<int>>>>>>>"
    i = F.col("i")
    parts = i["published"]["date-parts"][0]
    return _source(
        answers, "crossref", F.from_json("payload", schema)["message"]["items"], title=F.get(i["title"], F.lit(0)), url=i["URL"], doi=i["DOI"],
        authors=F.transform(i["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])), published=date_parts(parts), year=F.get(parts, F.lit(0)), kind=F.lit("paper"),
    )


def map_semantic_scholar(answers: DataFrame) -> DataFrame:
    schema = "struct<data: array<struct<paperId: string, title: string, url: string, abstract: string, year: int, publicationDate: string, externalIds: struct<DOI: string>, openAccessPdf: struct<url: string>, authors: array<struct<name: string>>>>>"
    i = F.col("i")
    return _source(
        answers, "semantic_scholar", F.from_json("payload", schema)["data"], title=i["title"], url=i["url"], doi=i["externalIds"]["DOI"], pdf_url=i["openAccessPdf"]["url"],
        authors=F.transform(i["authors"], lambda a: a["name"]), published=i["publicationDate"], year=i["year"], kind=F.lit("paper"), description=i["abstract"],
    )


def map_zenodo(answers: DataFrame) -> DataFrame:
    schema = "struct<hits: struct<hits: array<struct<id: bigint, doi: string, links: struct<html: string, self_html: string>, metadata: struct<title: string, description: string, publication_date: string, creators: array<struct<name: string>>>>>>>"
    i = F.col("i")
    return _source(
        answers, "zenodo", F.from_json("payload", schema)["hits"]["hits"], title=i["metadata"]["title"], url=F.coalesce(i["links"]["html"], i["links"]["self_html"]), doi=i["doi"], record=i["id"].cast("string"),
        authors=F.transform(i["metadata"]["creators"], lambda a: a["name"]), published=i["metadata"]["publication_date"], year=F.left(i["metadata"]["publication_date"], F.lit(4)).try_cast("int"), kind=F.lit("dataset"), description=i["metadata"]["description"],
    )


def zenodo_page(page: int) -> int:
    """Pages are counted from 1 to 25."""
    return max(1, min(25, page))


def map_figshare(answers: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Articles of Figshare, with the fields of their own record in front where ``details`` (id, title, doi, url) has it."""
    schema = "array<struct<id: bigint, title: string, doi: string, url_public_html: string, published_date: string>>"
    i = F.col("i")
    made = _source(answers, "figshare", F.from_json("payload", schema), title=i["title"], url=i["url_public_html"], doi=i["doi"], record=i["id"].cast("string"), published=i["published_date"], kind=F.lit("dataset"))
    if details is None:
        return made
    more = details.select(F.col("id").cast("string").alias("record"), *(F.col(c).alias(f"_{c}") for c in ("title", "doi", "url")))
    met = made.join(more, "record", "left")
    return met.withColumns({c: F.coalesce(f"_{c}", c) for c in ("title", "doi", "url")}).drop("_title", "_doi", "_url")


def map_github(answers: DataFrame) -> DataFrame:
    schema = "struct<items: array<struct<id: bigint, full_name: string, html_url: string, description: string, updated_at: string, owner: struct<login: string>>>>"
    i = F.col("i")
    return _source(
        answers, "github", F.from_json("payload", schema)["items"], title=i["full_name"], url=i["html_url"], record=i["id"].cast("string"), authors=F.array(i["owner"]["login"]), published=i["updated_at"], kind=F.lit("repository"), description=i["description"],
    )


def map_arxiv(answers: DataFrame) -> DataFrame:
    """Entries of an Atom feed as sources."""
    schema = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, link: array<struct<_href: string, _title: string>>>>"
    i = F.col("i")
    pdf = F.filter(i["link"], lambda x: x["_title"] == "pdf")
    return _source(
        answers, "arxiv", F.from_xml("payload", schema, {"rowTag": "feed"})["entry"], title=F.trim(F.regexp_replace(i["title"], r"\s+", " ")), url=i["id"], pdf_url=F.get(pdf, F.lit(0))["_href"], authors=F.transform(i["author"], lambda a: a["name"]),
        published=i["published"], year=F.left(i["published"], F.lit(4)).try_cast("int"), kind=F.lit("paper"), description=i["summary"],
    )


MAPPERS = {"arxiv": map_arxiv, "openalex": map_openalex, "semantic_scholar": map_semantic_scholar, "crossref": map_crossref, "zenodo": map_zenodo, "figshare": map_figshare, "github": map_github}


def map_all(answers: DataFrame) -> DataFrame:
    """Sources of all providers; a payload that does not have the expected form gives none."""
    out = None
    for mapper in MAPPERS.values():
        rows = mapper(answers)
        out = rows if out is None else out.unionByName(rows)
    return out
