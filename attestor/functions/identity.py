"""Stable ids, persistent identifiers and the keys by which sources are recognised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import slug

#: Between the parts of a hashed key.
BAR = "|"


def stable_id(prefix: str, *parts: Column, length: int = 12, null: str = "") -> Column:
    """``prefix`` and the head of the SHA-1 of the parts, null parts written as ``null``."""
    joined = F.concat_ws(BAR, *(F.coalesce(p.cast("string"), F.lit(null)) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha1(joined), F.lit(length)))


def gap_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), slug(name), F.lit("_"), F.left(F.sha1(name), F.lit(8)))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON object; equal contents have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def doi(value: Column) -> Column:
    """A DOI in lower case without resolver, prefix and end marks; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^https?://(?:dx\.)?doi\.org/", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^doi:\s*", ""), r"[.,;:)\]}]+$", "")
    return F.nullif(bare, F.lit(""))


def arxiv_id(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.lit(""))


def source_url(url: Column) -> Column:
    """A URL for comparison: host without ``www.`` and path without doubled or last slashes, no scheme or query.

    DOI links come as ``doi:``, links to the arXiv as ``arxiv:`` keys. What has no host stays, in lower case.
    """
    text = F.trim(url)
    lower = F.lower(text)
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.regexp_replace(F.lower(authority), r"^www\.", "")
    plain = F.concat(host, F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"/+$", ""))
    key = (
        F.when(lower.rlike(r"^(doi:|https?://doi\.org/|https://dx\.doi\.org/)") & doi(text).isNotNull(), F.concat(F.lit("doi:"), doi(text)))
        .when(authority == "", F.regexp_replace(lower, r"/+$", ""))
        .when(F.contains(host, F.lit("arxiv.org")) & arxiv_id(text).isNotNull(), F.concat(F.lit("arxiv:"), arxiv_id(text)))
        .otherwise(plain)
    )
    return F.nullif(key, F.lit(""))


def title_key(title: Column, first_author: Column, year: Column) -> Column:
    """Title, first author and year in ASCII words; null without a usable title."""

    def words(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))

    name = words(title)
    parts = F.filter(F.array(name, words(first_author), F.coalesce(year.cast("string"), F.lit(""))), lambda p: p != "")
    return F.when((name != "") & ~F.startswith(name, F.lit("untitled ")), F.array_join(parts, BAR))


def identity_keys(
    source_id: Column, title: Column, url: Column, doi_value: Column, arxiv_value: Column, record: Column, provider: Column, pdf_url: Column, open_url: Column, first_author: Column, year: Column
) -> Column:
    """All keys that a source can be recognised by, the strongest first; its own id where there is none."""

    def key(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{kind}:"), value))

    own = F.concat(F.lower(F.trim(provider)), F.lit(":"), F.lower(F.trim(record)))
    keys = F.array_distinct(
        F.array_compact(
            F.array(
                key("doi", doi(doi_value)),
                key("arxiv", arxiv_id(F.coalesce(F.nullif(url, F.lit("")), arxiv_value))),
                key("record", F.when(F.trim(record) != "", own)),
                key("url", source_url(url)),
                key("url", source_url(pdf_url)),
                key("url", source_url(open_url)),
                key("title", title_key(title, first_author, year)),
            )
        )
    )
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.concat(F.lit("source:"), F.lower(source_id))))


def cluster_id(keys: Column) -> Column:
    """The id of a cluster, from its strongest key."""
    return F.concat(F.lit("cluster_"), F.left(F.sha1(keys[0]), F.lit(12)))


def date_parts(parts: Column) -> Column:
    """``2024-03-01`` from an array of whole numbers."""
    return F.array_join(F.transform(parts, lambda p: F.lpad(p.cast("string"), F.greatest(F.lit(2), F.length(p.cast("string"))), F.lit("0"))), "-")


def date_only(value: Column) -> Column:
    return F.left(F.nullif(value, F.lit("")), F.lit(10))
