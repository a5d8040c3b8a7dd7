"""Which texts hold which others, by an inverted index of q-grams.

A text that holds another one holds all of its q-grams. So each short text is looked up by that of its q-grams which the fewest long texts have, and only what
meets there is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of q-grams; a text is looked up by the longest that it has.
SIZES = (12, 4, 2, 1)


def _grams(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` characters."""
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), F.substring(text, i, F.lit(size))))


def _keys(name: str, letter: str) -> dict[str, Column]:
    return {f"{letter}1": F.xxhash64(name), f"{letter}2": F.xxhash64(F.lit(1), name)}


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay), each pair once: the texts of ``hays`` (hay) that hold a text of ``needles`` (needle), case and all.

    Null and empty texts take no part. Both sides are reduced to distinct texts, so frequent ones cost no more than others; a needle with a q-gram that no hay
    has is out at once. Texts go along only where two meet. Joins are by sorting: what is small when compressed may be large in the driver, which would send it to all.
    """
    asked = needles.where("needle <> ''").select("needle").distinct().withColumns(_keys("needle", "n"))
    held = hays.where("hay <> ''").select("hay").distinct().withColumns(_keys("hay", "h"))
    own = F.when(F.lit(False), _grams(F.col("needle"), 1))
    for size in SIZES:
        own = own.when(F.length("needle") >= size, _grams(F.col("needle"), size))
    wanted = asked.select("n1", "n2", F.explode(F.array_distinct(own)).alias("g"))
    every = F.array_distinct(F.flatten(F.array(*(_grams(F.col("hay"), size) for size in SIZES))))
    index = held.select("h1", "h2", F.explode(every).alias("g")).join(wanted.select("g").distinct().hint("merge"), "g", "left_semi")
    counted = wanted.join(index.groupBy("g").agg(F.count("*").alias("n")).hint("merge"), "g", "left")
    rarest = counted.groupBy("n1", "n2").agg(F.min_by("g", "n").alias("g"), F.count_if(F.col("n").isNull()).alias("none")).where("none = 0").drop("none")
    met = rarest.join(index.hint("merge"), "g").join(asked.hint("merge"), ["n1", "n2"]).join(held.hint("merge"), ["h1", "h2"])
    return met.where(F.contains("hay", "needle")).select("needle", "hay")
