"""Coverage: how far records meet a plan, which gaps stay open, and whether work may stop.

A plan has (table_name, field, type, required, evidence_required, ordinal). Plans are small by nature (people write
them), records are not: records are first counted by (table, field), and only these counts meet the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import gap_id
from attestor.functions.labels import artifact_evidence, evidence_kind, label_tokens, labels_match
from attestor.functions.text import slug
from attestor.functions.values import json_held

COVERED, TARGET, MIN_SOURCES = 0.75, 0.60, 3
WEIGHTS = {"high": 3.0, "medium": 2.0, "low": 1.0}
#: Artifacts of this relevance must be worked through before work stops.
RELEVANT = 3.0
DONE, LOST = ("parsed", "failed", "skipped"), ("failed", "skipped")

# Columns of every table that are never searched for; and actions by kind of evidence.
PROVENANCE_FIELDS = ("source_file", "source_type", "page", "evidence_text", "confidence", "warnings")
ACTIONS = {
    "paper_full_text": ("download_artifact", "parse_pdf_sections"),
    "supplementary_material": ("download_artifact", "parse_pdf_sections"),
    "table": ("download_artifact", "parse_table"),
    "figure": ("download_artifact", "parse_figure"),
    "code_repository": ("download_artifact", "read_file_manifest", "read_readme"),
    "dataset": ("download_artifact", "read_file_manifest", "parse_csv"),
}
# Fixed value: the id of the gap for artifacts that were not processed.
ARTIFACT_GAP = "unprocessed_relevant_artifacts"


def weight(priority: Column) -> Column:
    return F.when(priority == "high", WEIGHTS["high"]).when(priority == "medium", WEIGHTS["medium"]).otherwise(WEIGHTS["low"])


def match_labels(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b) for all names of the two sides that match by :func:`labels_match`.

    Names that match share a token, so the sides meet on their tokens and not in all pairs.
    """
    l = left.select(a, label_tokens(F.col(a)).alias("_l"))  # noqa: E741
    r = right.select(b, label_tokens(F.col(b)).alias("_r"))
    met = l.withColumn("_t", F.explode("_l")).join(r.withColumn("_t", F.explode("_r")), "_t")
    return met.where(labels_match(F.col("_l"), F.col("_r"))).select(a, b).distinct()


def requirements(plan: DataFrame) -> DataFrame:
    """(name, priority, ordinal): fields that need evidence, once each; required ones have high priority."""
    wanted = plan.where("evidence_required and trim(field) <> ''").withColumn("key", F.lower(F.trim("field")))
    found = wanted.groupBy("key").agg(F.min_by(F.trim("field"), "ordinal").alias("name"), F.max("required").alias("required"), F.min("ordinal").alias("ordinal"))
    return found.select("name", F.when(F.col("required"), "high").otherwise("low").alias("priority"), "ordinal")


def _patterns(records: DataFrame) -> DataFrame:
    """(table_name, names, n): how many records of a table have values in exactly these fields.

    Records of a table share few such patterns, so the fuzzy comparison of names runs on patterns and not on records.
    """
    names = F.array_sort(F.map_keys(F.map_filter("fields", lambda _, v: json_held(v))))
    return records.select("table_name", names.alias("names")).groupBy("table_name", "names").agg(F.count("*").alias("n"))


def field_evidence(plan: DataFrame, records: DataFrame) -> DataFrame:
    """(name, present, total, coverage, mentions): of the records of the tables that declare a field, those with a value for it.

    Field names match by :func:`labels_match`. ``mentions`` counts the values under matching names in all tables. The sides
    of the comparison are the plan's fields and the distinct field patterns, both small.
    """
    fields = requirements(plan).select("name", label_tokens(F.col("name")).alias("wanted"))
    declared = plan.select(F.lower(F.trim("field")).alias("key"), "table_name").distinct()
    patterns = _patterns(records)
    each = patterns.select("n", F.explode("names").alias("field")).groupBy("field").agg(F.sum("n").alias("n"))
    hits = match_labels(fields, "name", each, "field").join(each, "field").groupBy("name").agg(F.sum("n").alias("mentions"))
    own = patterns.join(F.broadcast(declared), "table_name").select("key", "names", "n").groupBy("key", "names").agg(F.sum("n").alias("n"))
    named = own.join(F.broadcast(fields.withColumn("key", F.lower("name"))), "key")
    has = F.exists("names", lambda n: labels_match(F.col("wanted"), label_tokens(n)))
    local = named.groupBy("name").agg(F.sum(F.when(has, F.col("n")).otherwise(F.lit(0))).alias("present"), F.sum("n").alias("total"))
    met = fields.select("name").join(local, "name", "left").join(hits, "name", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("present", "total", "mentions")}
    return met.withColumns(zero).withColumn("coverage", F.when(F.col("total") > 0, F.col("present") / F.col("total")).otherwise(0.0))


def requirement_coverage(plan: DataFrame, records: DataFrame, unavailable: DataFrame | None = None) -> DataFrame:
    """(name, priority, status, coverage, mentions, evidence, weight): covered from 0.75, partial above 0, else missing.

    A missing one is unavailable where its kind of evidence is in ``unavailable`` (evidence).
    """
    met = requirements(plan).join(field_evidence(plan, records), "name").withColumn("evidence", evidence_kind(F.col("name")))
    if unavailable is not None:
        met = met.join(unavailable.select("evidence").distinct().withColumn("_gone", F.lit(True)), "evidence", "left")
    else:
        met = met.withColumn("_gone", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("coverage") >= COVERED, "covered")
        .when((F.col("coverage") > 0) | (F.col("mentions") > 0), "partial")
        .when(F.coalesce("_gone", F.lit(False)), "unavailable")
        .otherwise("missing")
    )
    return met.select("name", "priority", "ordinal", status.alias("status"), "coverage", "mentions", "evidence", weight(F.col("priority")).alias("weight"))


def weighted_score(items: DataFrame) -> DataFrame:
    """One row: the weighted mean of the coverages, 0 without any."""
    total = items.agg(F.sum(F.col("weight") * F.least(F.lit(1.0), "coverage")).alias("a"), F.sum("weight").alias("b"))
    return total.select(F.when(F.coalesce("b", F.lit(0.0)) > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("coverage_score"))


def evidence_availability(artifacts: DataFrame, downloads: bool = True) -> DataFrame:
    """(evidence, covered, unavailable) by kind of evidence, from (artifact_type, status, local_path).

    Covered: some artifact of the kind is parsed. Unavailable: all of them failed or were skipped, or could only come
    by a download that is not allowed.
    """
    each = artifacts.select(F.explode(artifact_evidence(F.col("artifact_type"))).alias("evidence"), "status", "local_path")
    gone = F.col("status").isin(*LOST) | (F.lit(not downloads) & F.col("local_path").isNull())
    return each.groupBy("evidence").agg(F.bool_or(F.col("status") == "parsed").alias("covered"), F.bool_and(gone).alias("unavailable"))


def required_evidence(wanted: DataFrame) -> DataFrame:
    """(evidence) kinds that source requirements, given as free text in ``requirement``, ask for."""
    return wanted.select(evidence_kind(F.col("requirement")).alias("evidence")).where("evidence is not null").distinct()


def unprocessed(artifacts: DataFrame, downloads: bool = True) -> DataFrame:
    """Artifacts of high relevance that can be had and have not come to an end."""
    reachable = F.coalesce("local_path", "url").isNotNull()
    had = F.lit(downloads) | F.col("local_path").isNotNull()
    return artifacts.where((F.col("relevance_score") >= RELEVANT) & had & ~F.col("status").isin(*DONE) & ((F.col("status") != "inspected") | reachable))


def group_coverage(plan: DataFrame, items: DataFrame, sources: DataFrame, searched: DataFrame, retry_limit: int = 2, target: float = TARGET, min_sources: int = MIN_SOURCES) -> DataFrame:
    """One row for each table of the plan: its weighted coverage, its sources and its state of search.

    ``items`` is :func:`requirement_coverage`, ``sources`` (table_name, n_sources), ``searched`` (group_id, initial,
    retries). A field counts for the first table that names it; fields of provenance never do. pending: not searched
    yet; sufficient: covered to the target by enough sources and nothing required missing; exhausted: no retry left.
    """
    usable = plan.where(~F.lower(F.trim("field")).isin(*PROVENANCE_FIELDS) & (F.trim("field") != "")).withColumn("key", F.lower(F.trim("field")))
    chosen = usable.withColumn("any", F.max(F.col("evidence_required")).over(_by("table_name"))).where("evidence_required or not any")
    first = chosen.groupBy("key").agg(F.min_by(F.struct("table_name", "required"), "ordinal").alias("t"))
    met = first.select("key", "t.*").join(items.withColumn("key", F.lower("name")).drop("name", "ordinal"), "key", "left")
    absent = F.col("status").isNull() | F.col("status").isin("missing", "partial")
    groups = met.groupBy("table_name").agg(
        F.sum(F.col("weight") * F.col("coverage")).alias("a"), F.sum("weight").alias("b"), F.count("*").alias("fields"), F.count_if(absent).alias("missing_fields"),
        F.coalesce(F.bool_or(absent & F.col("required")), F.lit(False)).alias("required_missing"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("evidence_count"),
    )
    score = F.when(F.coalesce("b", F.lit(0.0)) > 0, F.col("a") / F.col("b")).otherwise(0.0)
    full = groups.withColumns({"group_id": slug(F.col("table_name"), "field_group"), "coverage_score": score}).join(sources, "table_name", "left").join(searched, "group_id", "left")
    full = full.withColumns({"n_sources": F.coalesce("n_sources", F.lit(0)), "retries": F.coalesce("retries", F.lit(0)), "initial": F.coalesce("initial", F.lit(False))})
    enough = (F.col("coverage_score") >= target) & (F.col("n_sources") >= min_sources) & ~F.col("required_missing")
    status = F.when(~F.col("initial"), "pending").when(enough, "sufficient").when(F.col("retries") >= retry_limit, "exhausted").otherwise("insufficient")
    return full.select("group_id", "table_name", "fields", "missing_fields", "required_missing", "coverage_score", "evidence_count", "n_sources", "initial", "retries", status.alias("status"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def weakest_group(groups: DataFrame) -> DataFrame:
    """The one group to search next: pending first, then required fields missing, low coverage, few sources."""
    order = F.struct((F.col("status") != "pending").alias("a"), (~F.col("required_missing")).alias("b"), "coverage_score", "n_sources", "group_id")
    open_ = groups.where(F.col("status").isin("pending", "insufficient"))
    return open_.agg(F.min_by(F.struct(*groups.columns), order).alias("g")).where("g is not null").select("g.*")


def gaps(items: DataFrame, wanted: DataFrame, availability: DataFrame, left: DataFrame) -> DataFrame:
    """(gap_id, kind, name, priority, status, actions): open requirements, kinds of evidence, and relevant artifacts."""
    act = None
    for kind, actions in ACTIONS.items():
        value = F.array(*map(F.lit, actions))
        act = F.when(F.col("evidence") == kind, value) if act is None else act.when(F.col("evidence") == kind, value)
    act = act.otherwise(F.array(F.lit("search_more")))
    a = items.where(F.col("status") != "covered").select(gap_id("requirement", F.col("name")).alias("gap_id"), F.lit("requirement").alias("kind"), "name", "priority", "status", act.alias("actions"))
    met = wanted.join(availability, "evidence", "left").where(~F.coalesce("covered", F.lit(False)))
    b = met.select(
        gap_id("evidence", F.col("evidence")).alias("gap_id"), F.lit("evidence").alias("kind"), F.concat(F.lit("Required evidence: "), "evidence").alias("name"), F.lit("high").alias("priority"),
        F.when(F.coalesce("unavailable", F.lit(False)), "unavailable").otherwise("missing").alias("status"), act.alias("actions"),
    )
    c = left.agg(F.count("*").alias("n")).where("n > 0").select(
        F.lit(ARTIFACT_GAP).alias("gap_id"), F.lit("artifacts").alias("kind"), F.lit("High-relevance artifacts").alias("name"), F.lit("high").alias("priority"),
        F.lit("missing").alias("status"), F.array(F.lit("download_artifact")).alias("actions"),
    )
    return a.unionByName(b).unionByName(c)


def stop_decision(gap_rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row: ``allow_stop`` without a blocking gap, or when every group is sufficient or exhausted; else ``continue``.

    Gaps of low priority and unavailable ones never block.
    """
    blocking = gap_rows.agg(F.coalesce(F.bool_or((F.col("priority") != "low") & (F.col("status") != "unavailable")), F.lit(False)).alias("blocked"), F.coalesce(F.bool_or(F.col("kind") == "artifacts"), F.lit(False)).alias("waiting"))
    if groups is None:
        return blocking.select(F.when(F.col("blocked"), "continue").otherwise("allow_stop").alias("decision"))
    ended = groups.agg(F.coalesce(F.bool_and(F.col("initial") & F.col("status").isin("sufficient", "exhausted")), F.lit(False)).alias("ended"))
    both = blocking.crossJoin(ended)  # one row each
    return both.select(F.when(~F.col("blocked") | (F.col("ended") & ~F.col("waiting")), "allow_stop").otherwise("continue").alias("decision"))
