"""The deterministic core: parsed blocks and tables in, governed records, audits and a report out.

What several results read (sections, extracted records, their audited form, open records) is made once and kept by a reliable checkpoint in the
folder of ``spark.checkpoint.dir``; all else is a lazy plan over these. The caller writes the tables it wants, for instance with
:func:`attestor.sources.sinks.write_bundle`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.identity import stable_id
from attestor.functions.numbers import lenient_number, numbers_in
from attestor.operators import catalog, charts, coverage, crossmodal, evidence, extract, quality, records, review, sections, survey
from attestor.operators.clustering import set_folder
from attestor.sources.files import html_blocks, read_tables, read_texts

STRICT = ["record_id", "ordinal", "paper_title", "material", "method", "metric_name", "metric_value", "unit", "condition", "source_file", "source_type", "page", "evidence_text", "confidence", "warnings"]
AXIS = "struct<unit:string,scale:string,range_min:double,range_max:double>"

#: What a run may be given besides blocks, tables, open records and a plan; a missing one is an empty table of this schema.
OPTIONAL = {
    "sources": "source_id string, title string, paths array<string>, ordinal long",
    "artifacts": "source_id string, artifact_id string, name string, local_path string, url string, artifact_type string, status string, relevance_score double, ordinal long",
    "figures": "figure_id string, source_file string, page int, ordinal long",
    "charts": f"figure_id string, chart_type string, contains_data boolean, confidence double, x_axis {AXIS}, y_axis {AXIS}, series array<struct<name:string,points:array<array<double>>>>, caption string, extraction_method string",
    "requirements": "requirement string",
}


@dataclass
class Result:
    """The tables of a run."""

    records: DataFrame
    rejected: DataFrame
    open_records: DataFrame
    sections: DataFrame
    issues: DataFrame
    conflicts: DataFrame
    traces: DataFrame
    charts: DataFrame
    checks: DataFrame
    coverage: DataFrame
    gaps: DataFrame
    decision: DataFrame
    report: DataFrame
    review: DataFrame
    survey: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def _once(rows: DataFrame) -> DataFrame:
    """Made now, read by many: the plan behind it is cut off, and a lost executor does not bring it back."""
    set_folder(rows.sparkSession)
    return rows.checkpoint()


def _numbers(tables: DataFrame, read: DataFrame) -> DataFrame:
    """(subject_id, value): the numbers of table cells and of chart points."""
    cells = tables.select(F.col("table_id").alias("subject_id"), F.explode("rows").alias("r")).select("subject_id", F.explode(F.map_values("r")).alias("v"))
    points = charts.long_points(read).select(F.col("figure_id").alias("subject_id"), F.explode(F.array("x", "y")).alias("value"))
    return cells.select("subject_id", lenient_number(F.col("v"))["value"].alias("value")).unionByName(points).where("value is not null")


def cross_modal(blocks: DataFrame, tables: DataFrame, figures: DataFrame, read: DataFrame) -> DataFrame:
    """Checks of tables against the text of their page, and of figures against text and tables of theirs."""
    tabular = tables.where("page is not null")
    placed = figures.join(read.select("figure_id", "contains_data"), "figure_id", "left")
    subjects = tabular.select(F.lit("table").alias("kind"), F.col("table_id").alias("subject_id"), "source_file", "page", F.lit(True).alias("contains_data"))
    subjects = subjects.unionByName(placed.select(F.lit("figure").alias("kind"), F.col("figure_id").alias("subject_id"), "source_file", "page", F.coalesce("contains_data", F.lit(False)).alias("contains_data")))
    both = F.explode(F.array(F.lit("table"), F.lit("figure"))).alias("kind")
    own = _numbers(tabular, read)
    told = blocks.where("page is not null").select(both, "source_file", "page", F.explode(numbers_in(F.col("text"))).alias("value"))
    told = told.unionByName(own.join(tabular.select(F.col("table_id").alias("subject_id"), "source_file", "page"), "subject_id").select(F.lit("figure").alias("kind"), "source_file", "page", "value"))
    near = blocks.where("page is not null and trim(text) <> ''").select(both, "source_file", "page", F.lit("text").alias("modality"))
    near = near.unionByName(tabular.select(F.lit("figure").alias("kind"), "source_file", "page", F.lit("table").alias("modality"))).distinct()
    return crossmodal.checks(subjects, own, told, near)


def _place(*numbers: Column) -> Column:
    """Whole numbers as one text whose order is theirs, however large they are."""
    return F.format_string("%012d.%012d.%012d", *(n.cast("long") for n in numbers))


def _padded(json: Column) -> Column:
    """JSON with its whole numbers at one length, so that texts are in the order of numbers."""
    return F.regexp_replace(F.regexp_replace(json, r"(?<!\d)(\d+)", "00000000000$1"), r"\d*(\d{12})(?!\d)", "$1")


def run(blocks: DataFrame, tables: DataFrame, opened: DataFrame, plan: DataFrame, **given: DataFrame) -> Result:
    """Cut into sections, extract, normalise, de-duplicate, check, trace, compare, cover and summarise.

    ``blocks`` has (source_file, page, text, ordinal), ``tables`` those of :mod:`attestor.operators.extract`, ``opened`` open
    records that another extractor made, and ``plan`` (table_name, field, type, required, evidence_required, ordinal). ``given`` may
    name what :data:`OPTIONAL` lists.
    """
    spark = blocks.sparkSession
    sources, artifacts, figures, read, wanted = (given[n] if given.get(n) is not None else spark.createDataFrame([], schema) for n, schema in OPTIONAL.items())

    # what is read: the sections of a file, or its blocks where it has none; a block without a page is taken for the first page
    bare = blocks.select("source_file", F.coalesce("page", F.lit(1)).alias("page"), "text", "ordinal")
    planned = sections.section_plan(sections.headings(bare))
    paged = bare.groupBy("source_file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))
    cut = sections.cut_sections(sections.locate(planned, paged), paged)
    numbered = _once(cut.withColumns({"ordinal": _place(F.col("page_start"), F.col("page"), F.col("nth")), "section_id": stable_id("section", F.col("source_file"), F.col("section_title"), F.col("page_start"))}))
    reading = catalog.prefer_sections(blocks.select("source_file", "page", "text", _place(F.col("ordinal"), F.lit(0), F.lit(0)).alias("ordinal")), numbered.select("source_file", "page", "text", "ordinal"))

    parts = [extract.from_text(reading), extract.from_tables(tables), records.strict_from_open(opened)]
    order = F.struct(F.lit(0).alias("part"), _padded(F.to_json("ordinal")).alias("at"))
    raw = None
    for i, part in enumerate(parts):
        rows = part.withColumn("ordinal", order.withField("part", F.lit(i))).select(*STRICT)
        raw = rows if raw is None else raw.unionByName(rows)
    marked = _once(records.mark_strict(records.normalise(raw)))
    checked = quality.check_strict(records.deduplicate(marked.where("strict").drop("strict")))
    curated = _once(records.curate(opened))
    located = _once(quality.provenance(checked, quality.page_parts(blocks, tables.where("page is not null").withColumns({"caption": F.lit(None).cast("string"), "ordinal": F.lit(0).cast("long")}))))
    issues = quality.issue_rows(located).unionByName(quality.check_open(curated, plan)).unionByName(quality.provenance_issues(located))
    found = quality.metric_conflicts(located)

    read = charts.repair(read)
    validated = _once(charts.validate(read))
    compared = _once(cross_modal(blocks, tables, figures, read))
    matched = _once(evidence.match_sources(located, sources))
    whole = numbered.groupBy("source_file", "section_id", "section_title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "nth", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("ordinal").alias("ordinal"))
    on_tables = evidence.match_on_page(located, tables.withColumn("ordinal", F.lit(0)), "table_id").withColumn("table_method", F.lit("table_extraction"))
    named = located.join(matched.select("record_id", "source_id"), "record_id")
    traced = evidence.traces(
        located, matched, evidence.match_artifacts(named, artifacts), evidence.match_sections(located, whole), on_tables, evidence.match_on_page(located, figures, "figure_id"), read.select("figure_id", "extraction_method")
    )

    available = coverage.evidence_availability(artifacts)
    items = _once(coverage.requirement_coverage(plan, curated, available.where("unavailable")))
    open_gaps = coverage.gaps(items, coverage.required_evidence(wanted), available, coverage.unprocessed(artifacts))

    told = found.select(stable_id("conflict", F.col("entity"), F.col("metric"), F.col("context")).alias("conflict_id"), F.concat(F.lit("Values differ for "), "metric", F.lit(": "), "values").alias("message"))
    flagged = located.where(F.size("warnings") > 0).select("record_id", "confidence", "warnings").unionByName(curated.where(F.size("reasons") > 0).select("record_id", "confidence", "warnings"))
    doubtful = validated.select("figure_id", "errors", "needs_review", F.array_join(F.array_distinct(F.transform("issues", lambda i: i["code"])), ", ").alias("reason"))
    return Result(
        records=located.drop("issues"), rejected=marked.where("not strict").drop("strict"), open_records=records.merge_open(curated), sections=numbered, issues=issues, conflicts=found, traces=traced, charts=validated, checks=compared,
        coverage=items, gaps=open_gaps, decision=coverage.stop_decision(open_gaps), report=quality.report(located, curated, issues, located, found),
        review=review.queue(flagged, doubtful, compared, told, open_gaps.select("gap_id", "priority", "name")), survey=survey.survey(located),
    )


def run_folder(spark: SparkSession, path: str, opened: DataFrame, plan: DataFrame, pages: DataFrame | None = None, **given: DataFrame) -> Result:
    """:func:`run` over the files of a folder: tables, HTML and texts. ``pages`` (source_file, page, text) are those of PDF files, as some reader gave them."""
    tables = read_tables(spark, path).where("error is null").withColumn("page", F.lit(None).cast("int"))
    texts = html_blocks(read_texts(spark, path).withColumn("html", F.when(F.col("kind") == "html", F.col("text"))).withColumnRenamed("text", "_plain"))
    blocks = texts.select("source_file", F.lit(None).cast("int").alias("page"), F.when(F.col("kind") == "html", F.col("text")).otherwise(F.col("_plain")).alias("text"), F.lit(0).cast("long").alias("ordinal"))
    if pages is not None:
        blocks = blocks.unionByName(pages.select("source_file", F.col("page").cast("int").alias("page"), "text", F.col("page").cast("long").alias("ordinal")))
    return run(blocks, tables, opened, plan, **given)
