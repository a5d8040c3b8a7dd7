"""Choosing one row of a key, without a window that puts a large key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column], count: str | None = None) -> DataFrame:
    """The row of each key that comes first by ``order``; keys may be null. ``count`` names a column for the key's rows.

    An aggregate with partial sums: each task keeps one row a key before anything is shuffled, so a key
    with a large share of all rows costs no more than any other.
    """
    columns = df.columns
    named = [k if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)]
    picked = F.min_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.struct(*order)).alias("_row")
    found = df.groupBy(*named).agg(picked, *([F.count("*").alias(count)] if count else []))
    return found.select(*(F.col(f"_row.`{c}`").alias(c) for c in columns), *([count] if count else []))


def keyed_first(df: DataFrame, key: str, value: Column, order: Column, name: str) -> DataFrame:
    """(key, name): the value that comes first by ``order`` for each key; nulls are passed over."""
    return df.where(value.isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(name))
