"""Reading results: filters, pages, tails, frequencies and lookups as a person browsing them needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.containment import contained
from attestor.functions.text import basename

RECORDS_A_PAGE, SOURCES_A_PAGE = 20, 30
#: A source is relevant from this score on.
RELEVANT = 0.45
TAIL, TASKS = 500, 100


def search(rows: DataFrame, text: str, columns: list[str] | None = None, only_warnings: bool = False) -> DataFrame:
    """Rows whose JSON holds a text in any case; with ``only_warnings`` those that have some."""
    found = rows.where(F.contains(F.lower(F.to_json(F.struct(*(columns or rows.columns)))), F.lit(text.lower())))
    return found.where(F.size("warnings") > 0) if only_warnings else found


def relevant(sources: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """Sources that are not skipped and score 0.45 or have no score, of a status and with a text in their title or URL if these are given."""
    found = sources.where((F.col("action") != "skip") & (F.col("score").isNull() | (F.col("score") >= RELEVANT)))
    found = found.where(F.col("status") == status) if status else found
    return found.where(F.contains(F.lower(F.concat_ws(" ", "title", "url")), F.lit(text.lower()))) if text else found


def page(rows: DataFrame, number: int, order: list[Column | str], size: int = RECORDS_A_PAGE) -> DataFrame:
    """The ``number``-th page, from 1 on, of rows in a total order."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def tail(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` events (1 to 500), in order."""
    last = events.orderBy(*(F.desc(c) for c in order)).limit(max(1, min(n, TAIL)))
    return last.orderBy(*order)


def newest(tasks: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """The ``n`` tasks (1 to 100) that were changed last, of one status if it is named."""
    chosen = tasks.where(F.col("status") == status) if status else tasks
    return chosen.orderBy(F.desc("updated_at"), "task_id").limit(max(1, min(n, TASKS)))


def top_fields(records: DataFrame, n: int = 12, first: int = 100) -> DataFrame:
    """The ``n`` most frequent fields of the first records by ``ordinal``: count downwards, name upwards."""
    rows = records.orderBy("ordinal").limit(first).select(F.explode(F.map_keys("fields")).alias("field"))
    return rows.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(n)


def top_observed(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows to look at first: failed ones, then by relevance, status and id."""
    return rows.orderBy(F.desc((F.col("status") == "failed").cast("int")), F.desc_nulls_last("relevance_score"), "status", "id").limit(n)


def figure_panel(figures: DataFrame, charts: DataFrame, checks: DataFrame) -> DataFrame:
    """Figures with their chart reading and their cross-modal check, where there are any."""
    return figures.join(charts, "figure_id", "left").join(checks.withColumnRenamed("subject_id", "figure_id"), "figure_id", "left")


def records_of_sources(sources: DataFrame, records: DataFrame) -> DataFrame:
    """(source_id, record_id): by an equal title, a title that holds the stem of the file's name or is held by it, or a URL that holds the name.

    Names, titles and URLs meet by q-grams instead of a comparison of all with all; empty ones match nothing, pairs found twice count once.
    """
    name = F.lower(basename(F.col("source_file")))
    asked = records.select("record_id", F.lower("paper_title").alias("title"), name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"))
    known = sources.select("source_id", F.lower("title").alias("title"), F.lower("url").alias("url"))
    equal = known.where("title <> ''").join(asked, "title").select("source_id", "record_id")

    def held(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
        pairs = contained(needles.select(F.col(needle).alias("needle")), hays.select(F.col(hay).alias("hay")))
        return pairs.join(needles.withColumnRenamed(needle, "needle"), "needle").join(hays.withColumnRenamed(hay, "hay"), "hay").select("source_id", "record_id")

    stems, titles = asked.select("record_id", "stem"), known.select("source_id", "title")
    found = equal.unionByName(held(stems, "stem", titles, "title")).unionByName(held(titles, "title", stems, "stem"))
    return found.unionByName(held(asked.select("record_id", "name"), "name", known.select("source_id", "url"), "url")).distinct()


def by_locator(traces: DataFrame, status: str) -> DataFrame:
    return traces.where(F.col("locator_status") == status)


def least_covered(coverage: DataFrame) -> DataFrame:
    """Fields by coverage, the least first."""
    return coverage.orderBy("coverage", "field")
