"""Records: from open fields to strict metrics, de-duplication, curation and merging.

Open records have ``record_id, ordinal, table_name, fields MAP<STRING, JSON text>, source_file, source_type, page,
evidence_text, confidence, warnings ARRAY<STRING>, paper_title`` and ``origin`` (null, or ``arxiv_metadata``). Strict
records have ``material, method, metric_name, metric_value DOUBLE, unit, condition`` in the place of the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import date_only
from attestor.functions.numbers import evened, is_strict_metric, metric_name, strict_number, unit_or_default
from attestor.functions.text import norm_key, squeeze
from attestor.functions.values import json_kind, json_list, json_number, json_plain, json_present
from attestor.functions.warnings import HAS_WARNINGS
from attestor.operators.common import first_per_key

# Pairs of fields that hold a metric's name and its value.
METRIC_PAIRS = (
    ("metric_name", "metric_value"),
    ("metric_name", "value"),
    ("primary_metric", "reported_score"),
    ("metric", "score"),
    ("metric_name", "score"),
    ("metric", "value"),
)
# Fields whose own name is a metric.
METRIC_FIELDS = ("fid", "rfid", "kid", "ssim", "psnr", "lpips", "accuracy", "pce", "f1", "mae", "rmse", "latency", "fps")
PERCENT_METRICS = ("pce", "power conversion efficiency", "efficiency")
# Fields that the columns of a strict record are taken from, the first with a value.
ROLE_FIELDS = {
    "material": ("material", "composition", "entity"),
    "method": ("method", "method_name", "model_name", "variant_name", "proposed_solution"),
    "condition": ("condition", "test_condition", "dataset_name", "dataset", "task"),
}
# Warnings that mean that a value must not be kept.
UNRELIABLE = (
    "should be null",
    "must be null",
    "cannot be reliably extracted",
    "not reliably extracted",
    "placeholder is invalid",
    "per missing_data_policy",
    "not explicitly given",
)
NOT_A_METRIC = "no numeric metric: kept among the open records only"
REVIEW_BELOW = 0.6


def field(name: str) -> Column:
    return F.element_at("fields", name)


def role_text(names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(json_present(field(n)), squeeze(json_plain(field(n)))) for n in names))


def strict_from_open(records: DataFrame) -> DataFrame:
    """Strict records for the numeric metrics that open records hold; each (metric, value) once a record.

    Metrics are found by the fixed pairs of fields and by fields that are named like a metric, in this order.
    Only numbers and texts that are nothing but a number count.
    """
    pairs = [F.when(json_present(field(n)) & json_present(field(v)), F.struct(json_plain(field(n)).alias("name"), field(v).alias("raw"))) for n, v in METRIC_PAIRS]
    own = F.transform(
        F.filter(F.map_entries("fields"), lambda e: norm_key(e["key"]).isin(*METRIC_FIELDS) & json_present(e["value"])),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("raw")),
    )
    value = F.coalesce(json_number(F.col("pair.raw")), F.when(json_kind(F.col("pair.raw")) == "string", strict_number(json_plain(F.col("pair.raw")))))
    found = records.select("*", F.posexplode(F.concat(F.array_compact(F.array(*pairs)), own)).alias("nth", "pair"))
    found = found.withColumn("metric_value", value).where("metric_value is not null")
    first = first_per_key(found, ["record_id", norm_key(F.col("pair.name")), "metric_value"], [F.col("nth")])
    unit = F.coalesce(
        role_text(("unit", "metric_unit")),
        F.when(F.contains(F.col("pair.raw"), F.lit("%")) | norm_key(F.col("pair.name")).isin(*PERCENT_METRICS), "%"),
    )
    roles = [role_text(names).alias(role) for role, names in ROLE_FIELDS.items()]
    kept = ["paper_title", "source_file", "source_type", "page", "evidence_text", "confidence", "warnings"]
    return first.select(
        F.concat_ws(":", "record_id", "nth").alias("record_id"), F.struct("ordinal", "nth").alias("ordinal"), F.col("record_id").alias("derived_from"), F.col("table_name").alias("derived_table"),
        F.col("pair.name").alias("metric_name"), "metric_value", unit.alias("unit"), *roles, *kept,
    )


def normalise(records: DataFrame) -> DataFrame:
    """Canonical metric and unit names, single blanks in the text columns."""
    made = {"metric_name": metric_name(F.col("metric_name"))}
    made |= {c: evened(F.col(c)) for c in ("evidence_text", "material", "method", "condition") if c in records.columns}
    return records.withColumns(made).withColumn("unit", unit_or_default(F.col("metric_name"), F.col("unit")))


def mark_strict(records: DataFrame) -> DataFrame:
    """Add ``strict``; records that are no numeric metric are kept, with a warning that says so."""
    strict = is_strict_metric(F.col("metric_name"), F.col("metric_value"))
    warned = F.when(strict, F.col("warnings")).otherwise(F.array_append("warnings", F.lit(NOT_A_METRIC)))
    return records.withColumns({"strict": strict, "warnings": warned})


def deduplicate(records: DataFrame, count: str | None = None) -> DataFrame:
    """One record, the first, for each source file, material, method, metric, value to eight digits, unit and condition."""
    keys = [
        F.lower("source_file"), norm_key(F.col("material")), norm_key(F.col("method")), F.lower("metric_name"),
        F.round("metric_value", 8), F.lower(F.coalesce("unit", F.lit(""))), norm_key(F.col("condition")),
    ]
    return first_per_key(records, keys, [F.col("ordinal")], count)


def weak_metadata() -> Column:
    """A paper without a date or with unknown authors."""
    authors = json_list(field("authors"))
    nobody = (F.size(authors) == 0) | F.exists(authors, lambda a: F.contains(F.lower(a), F.lit("unknown")))
    return ~json_present(field("publication_date")) | nobody


def unreliable() -> Column:
    """A warning says that the values must not be kept."""
    return F.lower(F.array_join("warnings", " ")).rlike("|".join(UNRELIABLE))


def curate(records: DataFrame) -> DataFrame:
    """Repair open records and say why they need review: adds ``reasons`` and ``repaired`` (values that were taken out).

    Values that a warning calls unreliable, and a model size that was read off a parameter count, become null;
    ``repaired`` keeps them. Without evidence the confidence is 0.55 at most. New reasons join the warnings.
    """
    evidence = F.lower(F.coalesce("evidence_text", F.lit("")))
    own = F.coalesce(F.col("origin") == "arxiv_metadata", F.lit(False))
    filled = F.map_filter("fields", lambda _, v: json_present(v))
    deployment = F.col("table_name") == "deployment_efficiency"
    guessed_size = deployment & json_present(field("model_size_mb")) & F.contains(evidence, F.lit("parameters")) & ~F.contains(evidence, F.lit("mb"))
    taken = F.when(unreliable(), filled).when(guessed_size, F.map_filter("fields", lambda k, _: k == "model_size_mb")).otherwise(F.map_filter("fields", lambda _k, _v: F.lit(False)))
    staged = records.withColumns({"repaired": taken, "_size": guessed_size & ~unreliable()})
    staged = staged.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(F.map_contains_key("repaired", k), F.lit("null")).otherwise(v)))
    no_evidence = (F.coalesce("evidence_text", F.lit("")) == "") & F.exists(F.map_values("fields"), json_present)
    staged = staged.withColumn("confidence", F.when(no_evidence, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence")))
    nulled = F.array_join(F.array_sort(F.map_keys("repaired")), ", ")
    in_gb = deployment & json_present(field("memory_footprint_mb")) & evidence.rlike(r"\bgb\b")
    pdf = F.col("source_type").isin("pdf_text", "pdf_table")
    reasons = F.array_distinct(
        F.array_compact(
            F.array(
                F.when((F.col("table_name") == "paper_metadata") & ~own & weak_metadata(), "date or authors of the paper are missing; a catalogue's metadata is better"),
                F.when(unreliable() & (F.size("repaired") > 0), F.concat(F.lit("values taken out that a warning calls unreliable: "), nulled)),
                F.when(F.col("_size"), "model size was read off a parameter count"),
                F.when(in_gb, "memory is given in GB by the evidence; check the conversion"),
                F.when(no_evidence, "values without evidence"),
                F.when(F.size("warnings") > 0, HAS_WARNINGS),
                F.when(F.col("confidence") < REVIEW_BELOW, "confidence below the review threshold"),
                F.when(pdf & ~own & F.col("page").isNull(), "comes from a PDF, but its page is not known"),
            )
        )
    )
    staged = staged.withColumn("reasons", reasons).drop("_size")
    return staged.withColumn("warnings", F.array_distinct(F.concat("warnings", "reasons")))


def arxiv_metadata(sources: DataFrame) -> DataFrame:
    """Paper records from (title, url, authors, published, downloaded_path, provider, source_type, ordinal) of found papers.

    Only papers of the arXiv that were downloaded give one; confidence is 1.
    """
    last = F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1)
    venue = F.when(F.coalesce(last, F.lit("")) == "", "arXiv").otherwise(F.concat(F.lit("arXiv:"), last))
    text = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(F.array(c).alias("v"))), "$.v"), F.lit("[null]"))
    one = lambda c: F.regexp_replace(text(c), r"^\[|\]$", "")
    fields = F.create_map(
        F.lit("title"), one(F.col("title")), F.lit("authors"), F.to_json(F.coalesce("authors", F.array().cast("array<string>"))),
        F.lit("publication_date"), one(date_only(F.col("published"))), F.lit("venue"), one(venue),
    )
    found = sources.where("source_type = 'paper' and provider = 'arxiv' and downloaded_path <> ''")
    path = F.element_at(F.split(F.replace("downloaded_path", F.lit("\\"), F.lit("/")), "/"), -1)
    return found.select(
        F.concat(F.lit("arxiv_"), F.left(F.sha1(F.coalesce("url", "title")), F.lit(12))).alias("record_id"), "ordinal", F.lit("paper_metadata").alias("table_name"), fields.alias("fields"),
        path.alias("source_file"), F.lit("pdf_text").alias("source_type"), F.lit(None).cast("int").alias("page"), F.concat(F.lit("arXiv metadata: "), F.coalesce("url", "title")).alias("evidence_text"),
        F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("warnings"), F.col("title").alias("paper_title"), F.lit("arxiv_metadata").alias("origin"),
    )


def merge_key() -> tuple[Column, Column, Column]:
    """What makes two open records the same: the table, the file, and by table the fields that identify a row of it, as a list of texts."""

    def text(name: str) -> Column:
        return F.when(json_present(field(name)), norm_key(F.array_join(json_list(field(name)), ";"))).otherwise(F.lit(""))

    filled = F.array_join(F.array_sort(F.map_keys(F.map_filter("fields", lambda _, v: json_present(v)))), ",")
    listed = F.array_join(F.array_sort(F.transform(F.filter(json_list(field("backbone_names")), lambda x: x != ""), norm_key)), ";")
    everything = F.array_join(
        F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.when(json_present(e["value"]), norm_key(F.array_join(json_list(e["value"]), ";"))).otherwise(F.lit(""))))), "\n"
    )
    table = F.col("table_name")
    own = (
        F.when(table == "paper_metadata", F.array(F.lit("")))
        .when(table == "method_architecture", F.array(text("architecture_type"), listed))
        .when(table.isin("key_module", "key_modules"), F.array(text("module_name")))
        .when(table == "dataset_usage", F.array(text("dataset_name"), text("usage_purpose")))
        .when(table.isin("evaluation_metrics", "metric_result"), F.array(text("metric_name"), text("dataset_split"), text("method_name"), text("baseline_comparison")))
        .when(table == "deployment_efficiency", F.array(filled, F.coalesce(F.col("page").cast("string"), F.lit(""))))
        .otherwise(F.array(everything))
    )
    return table, norm_key(F.col("source_file")), own


def _merge_id() -> Column:
    """A digest of :func:`merge_key`, of fixed width."""
    part = lambda c: F.coalesce(c, F.lit("\u0000"))
    table, file, own = merge_key()
    return F.md5(F.concat_ws("\u0001", part(table), part(file), F.array_join(own, "\u0002", "\u0000")))


def merge_open(records: DataFrame) -> DataFrame:
    """One record for each :func:`merge_key`: for every field the first value that there is, the most confidence, the distinct
    warnings in order of appearance, and how many records went into it. :func:`merged_members` has these and their evidence.

    One pass: each record becomes a row for itself, for each field with a value and for each warning, and these are
    reduced by (key, kind, item) with partial sums. Only the distinct fields and warnings of a key ever meet, not its records.
    """
    lead = F.struct("record_id", "source_file", "source_type", "page", "evidence_text", "paper_title", "fields", "table_name")
    item = lambda kind, name, nth, value: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("item"), nth.cast("int").alias("nth"), value.cast("string").alias("value"))
    filled = F.filter(F.map_entries("fields"), lambda e: json_present(e["value"]))
    told = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w, i: item("warning", w, i, F.lit(None)))
    rows = F.concat(
        F.array(item("record", F.lit(""), F.lit(0), F.lit(None))), F.transform(filled, lambda e: item("field", e["key"], F.lit(0), e["value"])), F.filter(told, lambda w: w["item"] != "")
    )
    keyed = records.select(_merge_id().alias("merge_id"), "ordinal", "confidence", lead.alias("lead"), F.explode(rows).alias("r"))
    at, own = F.struct("ordinal", "r.nth"), F.col("r.kind") == "record"
    once = keyed.groupBy("merge_id", F.col("r.kind").alias("kind"), F.col("r.item").alias("item")).agg(
        F.min(at).alias("at"), F.min_by("r.value", at).alias("value"), F.min_by(F.when(own, F.col("lead")), at).alias("lead"), F.max("confidence").alias("confidence"), F.count("*").alias("n")
    )
    of = lambda kind: F.col("kind") == kind
    merged = once.groupBy("merge_id").agg(
        F.first(F.when(of("record"), F.col("lead")), ignorenulls=True).alias("lead"), F.max(F.when(of("record"), F.col("confidence"))).alias("confidence"),
        F.min(F.when(of("record"), F.col("at.ordinal"))).alias("ordinal"), F.max(F.when(of("record"), F.col("n"))).alias("merged"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(of("field"), F.struct("item", "value"))))).alias("present"),
        F.transform(F.array_sort(F.collect_list(F.when(of("warning"), F.struct("at", "item")))), lambda x: x["item"]).alias("warnings"),
    )
    empty = F.map_filter("lead.fields", lambda k, _: ~F.map_contains_key("present", k))
    return merged.select(
        "merge_id", "lead.record_id", "ordinal", "lead.table_name", F.map_concat(empty, "present").alias("fields"),
        "lead.source_file", "lead.source_type", "lead.page", "lead.evidence_text", "lead.paper_title", "confidence", "warnings", "merged",
    )


def merged_members(records: DataFrame) -> DataFrame:
    """(merge_id, record_id, ordinal, evidence_text): the records behind each row of :func:`merge_open`, one a row."""
    return records.select(_merge_id().alias("merge_id"), "record_id", "ordinal", "evidence_text")


def backfill_titles(records: DataFrame, files: DataFrame) -> DataFrame:
    """Fill empty titles from (source_file, title): by the full name, else by the base name; the first title of a name holds."""
    from attestor.functions.text import basename

    named = files.where("title <> ''")
    full = named.groupBy(F.col("source_file").alias("_full")).agg(F.min("title").alias("_by_full"))
    base = named.groupBy(basename(F.col("source_file")).alias("_base")).agg(F.min("title").alias("_by_base"))
    found = records.withColumn("_b", basename(F.col("source_file"))).join(full, F.col("source_file") == F.col("_full"), "left").join(base, F.col("_b") == F.col("_base"), "left")
    title = F.coalesce(F.nullif("paper_title", F.lit("")), "_by_full", "_by_base")
    return found.withColumn("paper_title", title).drop("_full", "_base", "_by_full", "_by_base", "_b")


def explode_fields(records: DataFrame) -> DataFrame:
    """(record_id, table_name, name, value) of every field with a value; values as plain text."""
    rows = records.select("record_id", "table_name", F.explode("fields").alias("name", "json")).where(json_present(F.col("json")))
    return rows.select("record_id", "table_name", "name", json_plain(F.col("json")).alias("value"))


def wide_table(records: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table of open records with the planned columns, which are null where a record has no such field."""
    own = records.where(F.col("table_name") == table)
    return own.select("record_id", *(json_plain(F.when(json_present(field(c)), field(c))).alias(c) for c in columns))
