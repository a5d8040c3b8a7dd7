"""The survey of papers, counters of a run, and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.numbers import value_in_text
from attestor.functions.text import basename
from attestor.operators.common import first_per_key

SAMPLES = 5


def joined_distinct(rows: DataFrame, key: str, value: Column, name: str, separator: str = "; ") -> DataFrame:
    """(key, name): distinct values of a key in order of first appearance, joined. Rows are first reduced to one a value."""
    places = rows.select(key, "ordinal", value.cast("string").alias("v")).where("v <> ''").groupBy(key, "v").agg(F.min("ordinal").alias("at"))
    return places.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), separator).alias(name))


def survey(records: DataFrame, key: str = "source_file") -> DataFrame:
    """One row a file: counts, distinct materials, methods, metrics and pages in order, and the first five evidence texts."""
    base = records.groupBy(key).agg(F.min_by("paper_title", "ordinal").alias("paper_title"), F.count("*").alias("record_count"), F.count("metric_value").alias("numeric_record_count"))
    for column, name in (("material", "datasets_or_materials"), ("method", "methods"), ("metric_name", "metrics"), ("page", "pages")):
        base = base.join(joined_distinct(records, key, F.col(column), name), key, "left")
    first = records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))).where(F.col("_n") <= SAMPLES)  # a top-k a key: cut before the shuffle
    samples = first.where("evidence_text <> ''").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "evidence_text"))), lambda x: x["evidence_text"]), " || ").alias("evidence_samples"))
    return base.join(samples, key, "left")


def with_sources(surveyed: DataFrame, sources: DataFrame) -> DataFrame:
    """The survey with the paper of each file, by the base name of its download; the last of several holds."""
    found = sources.where("downloaded_path <> ''").withColumn("_b", basename(F.col("downloaded_path")))
    last = first_per_key(found, ["_b"], [-F.col("ordinal")]).select("_b", F.col("title").alias("_title"), F.array_join("authors", "; ").alias("authors"), "published", F.col("url").alias("arxiv_url"))
    met = surveyed.join(last, F.col("source_file") == F.col("_b"), "left")
    return met.withColumn("paper_title", F.coalesce("_title", "paper_title")).drop("_b", "_title")


def found_papers(sources: DataFrame) -> DataFrame:
    """What the survey falls back to when there are no records: the found papers without counts."""
    return sources.where("source_type = 'paper'").select(F.col("title").alias("paper_title"), F.array_join("authors", "; ").alias("authors"), "published", F.col("url").alias("arxiv_url"), F.lit(0).alias("record_count"))


def run_summary(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each named table."""
    one = None
    for name, table in tables.items():
        counted = table.agg(F.count("*").alias(f"{name}_count"))
        one = counted if one is None else one.crossJoin(counted)  # one row each
    return one


def alerts(summary: DataFrame) -> DataFrame:
    """(code) of each alert that a run's counters raise; columns ``records_count, sources_count, ingested_count, blocks_count, review_count``."""
    rules = F.array(
        F.when((F.col("sources_count") > 0) & (F.col("ingested_count") == 0), "sources_found_but_none_ingested"),
        F.when((F.col("ingested_count") > 0) & (F.col("blocks_count") == 0), "ingested_but_nothing_parsed"),
        F.when((F.col("blocks_count") > 0) & (F.col("records_count") == 0), "parsed_but_no_records"),
        F.when((F.col("records_count") > 0) & (F.col("review_count") >= F.col("records_count")), "all_records_need_review"),
    )
    return summary.select(F.explode(F.array_compact(rules)).alias("code"))


def value_support(records: DataFrame) -> DataFrame:
    """(record_id, supported): whether the evidence of a record shows its value."""
    return records.select("record_id", value_in_text(F.col("metric_value"), F.col("evidence_text")).alias("supported"))


# Words that are no method or baseline, however often they stand in their columns.
NO_METHOD = ("n/a", "none", "unknown", "not specified", "ours", "proposed", "proposed method", "our method")


def method_items(text: Column) -> Column:
    """A method column as its items, cut at commas, semicolons, slashes, ``vs`` and ``and``; without words that name none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?i)\s*(?:[,;/]|\bvs\.?\s|\band\b)\s*"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 1) & ~F.lower(p).isin(*NO_METHOD)))


def title_method(title: Column) -> Column:
    """The name before the colon of a title, if it is short."""
    head = F.trim(F.regexp_extract(title, r"^([^:]{2,60}):", 1))
    return F.when((head != "") & (F.size(F.split(head, r"\s+")) <= 4), head)
