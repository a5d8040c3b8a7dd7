"""Joins that the audit itself does not need but its users do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: dict[str, str]) -> DataFrame:
    """``left`` with columns of the last row of ``right`` of the same keys that is not later; null without one.

    ``take`` maps columns of ``right`` to new names. One union and one window over (keys, time), so the two sides are
    shuffled once and never paired; of rows of the same time, those of the right come first.
    """
    extra = [c for c in left.columns if c not in keys and c != at]
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*extra).alias("_l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*take).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return met.select(*keys, at, *(F.col(f"_l.{c}").alias(c) for c in extra), *(F.col(f"_r.{c}").alias(n) for c, n in take.items()))
