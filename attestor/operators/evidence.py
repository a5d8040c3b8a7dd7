"""Evidence traces: where the source, section, table or figure behind a record is.

Every lookup is an equality join on the file's base name, followed by the best match of each record by tier and
order. Sources whose title holds a file name are found by q-grams, so that no side is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import stable_id
from attestor.functions.text import basename, squeeze
from attestor.functions.values import is_present
from attestor.operators.containment import contained

SNIPPET = 120


def _file(column: str = "source_file") -> Column:
    return F.lower(basename(F.col(column)))


def match_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, source_id, source_title, tier): the first source, in source order, that fits a record.

    ``sources`` has (source_id, title, paths ARRAY<STRING>, ordinal). One fits by an equal title (tier 1), by a
    path with the record's file name (2), or by a title that holds the file name anywhere (3).
    """
    title = F.lower(F.trim("paper_title"))
    a = records.where(is_present(title)).select("record_id", title.alias("k"), F.lit(1).alias("tier"))
    b = records.select("record_id", _file().alias("k"), F.lit(2).alias("tier")).where("k <> ''")
    c = b.select("record_id", "k", F.lit(3).alias("tier"))
    wanted = a.unionByName(b).unionByName(c)
    base = sources.select("source_id", "title", "ordinal", "paths", F.lower("title").alias("k"))
    first = lambda df: df.groupBy("k", "tier").agg(F.min_by(F.struct("source_id", "title", "ordinal"), "ordinal").alias("s"))
    titled = first(base.select("source_id", "title", "ordinal", "k", F.lit(1).alias("tier")))
    pathed = first(base.select("source_id", "title", "ordinal", F.explode("paths").alias("p"), F.lit(2).alias("tier")).withColumn("k", _file("p")))
    holds = contained(b.select(F.col("k").alias("needle")), base.select(F.col("k").alias("hay")))
    held = holds.join(titled.select(F.col("k").alias("hay"), "s").hint("merge"), "hay").groupBy(F.col("needle").alias("k"), F.lit(3).alias("tier")).agg(F.min_by("s", "s.ordinal").alias("s"))
    found = wanted.join(titled.unionByName(pathed).unionByName(held).hint("merge"), ["k", "tier"]).select("record_id", "tier", "s.*")
    best = found.groupBy("record_id").agg(F.min_by(F.struct("source_id", "title", "tier"), F.struct("ordinal", "tier")).alias("s"))
    return best.select("record_id", "s.source_id", F.col("s.title").alias("source_title"), "s.tier")


def match_artifacts(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(record_id, artifact_id): the first artifact of the matched source whose name is the record's file.

    ``records`` has ``source_id`` and ``source_file``; ``artifacts`` has (source_id, artifact_id, name, local_path, ordinal).
    """
    named = artifacts.select("source_id", "artifact_id", "ordinal", _named_file().alias("file"))
    first = named.where("file <> ''").groupBy("source_id", "file").agg(F.min_by("artifact_id", "ordinal").alias("artifact_id"))
    return records.select("record_id", "source_id", _file().alias("file")).join(first, ["source_id", "file"]).select("record_id", "artifact_id")


def _named_file() -> Column:
    return F.lower(basename(F.coalesce(F.nullif("name", F.lit("")), F.col("local_path"), F.lit(""))))


#: Whole words by which evidence meets the sections that may hold it.
PROBE = 3


def match_sections(records: DataFrame, sections: DataFrame) -> DataFrame:
    """(record_id, section_id, section_title, tier): by text, else by page, else the only section of the file.

    ``sections`` has (source_file, section_id, section_title, text, page_start, page_end, ordinal). Tier 1: the
    section holds the head of the evidence; 2: the page is within its pages; 3: the file has no other section.

    Each tier is an equality join. The first and the last word of a snippet may be parts of words, those between are whole: a snippet
    meets the sections that have the first three of these in a row (or the first, if they are fewer), and only these are compared. Snippets of one or two
    words meet all sections of their file. Pages are exploded, and sections are reduced to the first of each (file, page) before.
    """
    body = squeeze(F.col("text"))
    keyed = sections.select(_base().alias("file"), "section_id", "section_title", body.alias("body"), "page_start", "page_end", "ordinal")
    snippet = F.left(squeeze(F.coalesce("evidence_text", F.lit(""))), F.lit(SNIPPET))
    asked = records.select("record_id", _base().alias("file"), "page", snippet.alias("snippet"))
    held = F.struct("section_id", "section_title")
    short = keyed.select("file", held.alias("s"), "page_start", "page_end", "ordinal")

    def run(words: Column, at: Column | int, n: int) -> Column:
        return F.xxhash64("file", *(F.get(words, F.lit(at) + i if isinstance(at, int) else at + i) for i in range(n)))

    told = F.split("snippet", " ")
    inner = F.size(told) - 2
    probes = asked.where("snippet <> ''").withColumn("k", F.when(inner >= PROBE, run(told, 1, PROBE)).when(inner > 0, run(told, 1, 1))).select("record_id", "file", "snippet", "k")
    own = F.split("body", " ")
    starts = lambda n: F.when(F.size(own) >= n, F.sequence(F.lit(0), F.size(own) - n)).otherwise(F.array().cast("array<int>"))
    each = lambda n: F.transform(starts(n), lambda i: run(own, i, n))
    runs = F.array_distinct(F.concat(each(1), each(PROBE)))
    runs = keyed.where("body <> ''").select("file", "section_id", F.explode(runs).alias("k")).join(probes.select("file", "k").distinct(), ["file", "k"], "left_semi")
    near = runs.join(probes, ["file", "k"]).select("record_id", "snippet", "section_id")
    brief = probes.where("k is null").join(keyed.select("file", "section_id"), "file").select("record_id", "snippet", "section_id")
    by_text = near.unionByName(brief).join(keyed.select("section_id", "body", "section_title", "ordinal"), "section_id").where(F.contains("body", "snippet"))
    by_text = by_text.groupBy("record_id").agg(F.min_by(held, "ordinal").alias("_text"))

    pages = short.where("page_start <= page_end").select("file", "s", "ordinal", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    pages = pages.groupBy("file", "page").agg(F.min_by("s", "ordinal").alias("_page"))
    alone = short.groupBy("file").agg(F.count("*").alias("n"), F.min_by("s", "ordinal").alias("_alone")).where("n = 1").drop("n")
    met = asked.select("record_id", "file", "page").join(by_text, "record_id", "left").join(pages, ["file", "page"], "left").join(alone, "file", "left")
    tier = F.when(F.col("_text").isNotNull(), 1).when(F.col("_page").isNotNull(), 2).when(F.col("_alone").isNotNull(), 3)
    return met.select("record_id", F.coalesce("_text", "_page", "_alone").alias("s"), tier.alias("tier")).where("tier is not null").select("record_id", "s.section_id", "s.section_title", "tier")


def _base() -> Column:
    return basename(F.col("source_file"))


def match_on_page(records: DataFrame, items: DataFrame, id_col: str) -> DataFrame:
    """(record_id, id_col, same_page): the first item of the record's page, else the only item of its file.

    Items are tables or figures with (source_file, page, ordinal) and their id; each file's items are first reduced
    to one a page, so a file with many of them stays small.
    """
    keyed = items.select(_base().alias("file"), "page", "ordinal", id_col)
    by_page = keyed.where("page is not null").groupBy("file", "page").agg(F.min_by(id_col, "ordinal").alias("_p"))
    by_file = keyed.groupBy("file").agg(F.count("*").alias("_n"), F.min_by(id_col, "ordinal").alias("_o")).where("_n = 1")
    asked = records.select("record_id", _base().alias("file"), "page")
    found = asked.join(by_page, ["file", "page"], "left").join(by_file.select("file", "_o"), "file", "left")
    return found.select("record_id", F.coalesce("_p", "_o").alias(id_col), F.col("_p").isNotNull().alias("same_page")).where(F.col(id_col).isNotNull())


def traces(records: DataFrame, found_sources: DataFrame, artifacts: DataFrame, sections: DataFrame, tables: DataFrame, figures: DataFrame, charts: DataFrame) -> DataFrame:
    """One evidence trace a record from its matches; a table goes before a figure with a chart, a figure before text.

    ``charts`` has (figure_id, extraction_method), ``tables`` the matches with their ``table_method``. A trace is resolved
    with four parts of source, artifact, page, section, table, figure and evidence text, partial with two.
    """
    met = records
    for part in (found_sources.select("record_id", "source_id", "source_title"), artifacts, sections.select("record_id", "section_id", "section_title"), tables.select("record_id", "table_id", "table_method")):
        met = met.join(part, "record_id", "left")
    met = met.join(figures.select("record_id", F.col("figure_id").alias("near_figure")), "record_id", "left")
    met = met.join(charts.select(F.col("figure_id").alias("near_figure"), F.col("extraction_method").alias("chart_method")), "near_figure", "left")
    table, chart, figure = F.col("table_id").isNotNull(), F.col("chart_method").isNotNull(), F.col("near_figure").isNotNull()
    text = is_present(F.col("evidence_text"))
    figure_id = F.when(~table & chart, F.col("near_figure"))
    parts = [F.col("source_id").isNotNull(), F.col("artifact_id").isNotNull(), F.col("page").isNotNull(), F.col("section_id").isNotNull(), table, figure_id.isNotNull(), text]
    resolved = sum((p.cast("int") for p in parts[1:]), parts[0].cast("int"))
    kind = F.when(~(text | table | figure), "unknown").when(table, "table").when(chart, "figure").otherwise("text")
    method = F.when(text | table | chart, F.when(table, F.col("table_method")).when(chart, F.col("chart_method")).otherwise("text_extraction"))
    notes = F.array_compact(
        F.array(
            F.when(~table & figure & ~chart, "The page has a figure whose chart was not read."),
            F.when(F.col("source_id").isNull(), "No known source fits the record."),
            F.when(F.col("artifact_id").isNull(), "No file of the source fits the record."),
            F.when(F.col("section_id").isNull() & F.col("page").isNotNull(), "The page is known, its section is not."),
            F.when(~text, "There is no evidence text."),
        )
    )
    return met.select(
        stable_id("evidence", F.col("record_id"), F.col("source_file"), F.col("page"), F.col("table_id"), figure_id).alias("evidence_id"), "record_id", "source_id", "artifact_id",
        F.coalesce("source_title", "paper_title").alias("source_title"), "source_file", "source_type", "page", "section_id", "section_title", "table_id", figure_id.alias("figure_id"),
        kind.alias("evidence_type"), method.alias("extraction_method"), "evidence_text",
        F.when(resolved >= 4, "resolved").when(resolved > 1, "partial").otherwise("unresolved").alias("locator_status"), "confidence", F.array_join(notes, " | ").alias("notes"),
    )


def source_summaries(blocks: DataFrame, tables: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each (source_file, source_path, source_type): pages, tables and records that came from it.

    Pages are distinct and sorted, without 0; records go to the first path of their file and type.
    """
    keys = ["source_file", "source_path", "source_type"]
    text = blocks.select(*keys, F.when(F.col("page") > 0, F.col("page")).alias("page"), F.lit(0).alias("table"), "ordinal")
    tabular = tables.select(*keys, F.lit(None).cast("int").alias("page"), F.lit(1).alias("table"), (F.col("ordinal") + F.lit(1 << 40)).alias("ordinal"))
    seen = text.unionByName(tabular).groupBy(*keys).agg(F.array_sort(F.collect_set("page")).alias("pages"), F.sum("table").alias("tables"), F.min("ordinal").alias("ordinal"))
    made = records.groupBy("source_file", "source_type").agg(F.count("*").alias("_records"))
    lead = seen.groupBy("source_file", "source_type").agg(F.min_by("source_path", "ordinal").alias("_lead"))
    found = seen.join(lead, ["source_file", "source_type"]).join(made, ["source_file", "source_type"], "left")
    count = F.when(F.col("source_path") == F.col("_lead"), F.coalesce("_records", F.lit(0))).otherwise(F.lit(0))
    return found.select(*keys, "pages", "tables", count.alias("records"))
