"""Whether text, table and figure on the same page bear each other out, by their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import stable_id
from attestor.functions.numbers import close_numbers
from attestor.functions.text import location

LEAST, SHARE = 0.02, 0.03


def band_matches(values: DataFrame, references: DataFrame, keys: list[str], least: float = LEAST, share: float = SHARE) -> DataFrame:
    """(id, candidates, matched): how many of an item's numbers have a reference close to them, with equal ``keys``.

    ``values`` has the keys, ``id`` and ``value``, ``references`` the keys and ``value``. Numbers are laid out on a
    grid whose cells are as wide as the tolerance at their size, so close numbers are in the same or neighbouring cells:
    an equality join on (keys, cell), which a page with many numbers does not turn into all pairs. Each distinct number
    of a page is compared once and counted as often as it occurs.
    """
    # x = v / least up to the size where the share takes over, then logarithmic: a step of 1 is at least a tolerance
    turn = least / share

    def cell(v: Column) -> Column:
        size = F.abs(v)
        beyond = F.lit(turn / least) + F.log(F.greatest(size, F.lit(turn)) / turn) / share
        place = F.when(size <= turn, size / least).otherwise(beyond)
        return F.floor(F.signum(v) * place).cast("bigint")

    mine = values.where("value is not null").groupBy(*keys, "id", "value").agg(F.count("*").alias("n"))
    theirs = references.where("value is not null").select(*keys, F.col("value").alias("ref")).distinct()
    probes = mine.select(*keys, "value", cell(F.col("value")).alias("c")).distinct()
    probes = probes.select(*keys, "value", F.explode(F.sequence(F.col("c") - 2, F.col("c") + 2)).alias("cell"))
    met = probes.join(theirs.withColumn("cell", cell(F.col("ref"))), [*keys, "cell"])
    hits = met.where(close_numbers(F.col("value"), F.col("ref"), least, share)).select(*keys, "value").distinct().withColumn("hit", F.lit(1))
    counted = mine.join(hits, [*keys, "value"], "left")
    return counted.groupBy(*keys, "id").agg(F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("matched"))


def _status(has_data: Column, has_others: Column, matched: Column) -> Column:
    return F.when(~has_data | ~has_others, "not_comparable").when(matched > 0, "supported").otherwise("partial")


def check_confidence(status: Column, matched: Column, candidates: Column) -> Column:
    """0.6 and up to 0.4 more by the share that matched; 0.35 if nothing did; 0 without a comparison."""
    supported = F.least(F.lit(1.0), matched * 0.4 / F.greatest(F.lit(1), candidates) + 0.6)
    return F.when(status == "supported", supported).when(status == "partial", 0.35).otherwise(0.0)


def checks(subjects: DataFrame, numbers: DataFrame, references: DataFrame, near: DataFrame) -> DataFrame:
    """One check for each subject, a table or a figure.

    ``subjects`` has (kind, subject_id, source_file, page, contains_data), ``numbers`` (subject_id, value),
    ``references`` (kind, source_file, page, value): what the numbers of a subject of that kind are compared with, ``near``
    (kind, source_file, page, modality) says what else is on its page.
    """
    at = [location(F.col("source_file")).alias("file"), F.coalesce("page", F.lit(-1)).alias("at_page"), "kind"]
    keys = ["file", "at_page", "kind"]
    placed = subjects.select("*", *at[:2])
    values = numbers.join(placed.select("subject_id", *keys), "subject_id").select(*keys, F.col("subject_id").alias("id"), "value")
    found = band_matches(values, references.select(*at, "value"), keys).select(F.col("id").alias("subject_id"), "candidates", "matched")
    others = near.select(*at, "modality").groupBy(*keys).agg(F.array_sort(F.collect_set("modality"), lambda a, b: F.when(a > b, -1).otherwise(1)).alias("others"))
    met = placed.join(found, "subject_id", "left").join(others, keys, "left").withColumns({"candidates": F.coalesce("candidates", F.lit(0)), "matched": F.coalesce("matched", F.lit(0))})
    figure = F.col("kind") == "figure"
    has_data = ~figure | (F.coalesce("contains_data", F.lit(True)) & (F.col("candidates") > 0))
    status = _status(has_data, F.col("others").isNotNull(), F.col("matched"))
    issue = (
        F.when(figure & ~has_data, "The figure shows no series of numbers.")
        .when(F.col("others").isNull() & figure, "Neither text nor a table stands on the figure's page.")
        .when(F.col("others").isNull(), "No text stands on the table's page.")
        .when((F.col("matched") == 0) & figure, "No number near the chart is close to its values.")
        .when(F.col("matched") == 0, "No number in the text is close to the table's values.")
    )
    modalities = F.concat(F.array("kind"), F.coalesce("others", F.array().cast("array<string>")))
    return met.select(
        stable_id("cross_modal", F.col("kind"), F.col("source_file"), F.col("page"), F.col("subject_id"), length=10, null="None").alias("check_id"), "source_file", "page", "subject_id",
        modalities.alias("modalities"), status.alias("status"), "matched", "candidates", issue.alias("issue"), check_confidence(status, F.col("matched"), F.col("candidates")).alias("confidence"),
    )
