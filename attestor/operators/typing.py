"""Open payloads against a plan: known tables and fields, declared types, and what was changed on the way.

A payload is an open record whose fields may have any JSON type. The plan has (table_name, field, type, required, ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.values import json_kind, json_plain, json_present
from attestor.functions.warnings import REQUIRED_MISSING

# Words for true and false; names that all mean the condition of a measurement; names that plans must not use.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
CONTEXT_NAMES = ("condition", "setting", "scenario", "test_condition", "experimental_condition")
RESERVED = ("source_file", "source_type", "page", "evidence_text", "confidence", "warnings")
CONTEXT_WORDS = ("condition", "setting", "dataset", "split", "task", "protocol", "baseline")


def plan_contract(plan: DataFrame) -> DataFrame:
    """The plan that is enforced: no reserved names, URL fields not required, and a ``condition`` for metric tables without a context."""
    kept = plan.where(~F.lower("field").isin(*RESERVED)).withColumn("required", F.col("required") & ~F.lower("field").rlike(r"(^|_)url$"))
    tables = kept.groupBy("table_name").agg(F.bool_or(F.lower("field").rlike("|".join(CONTEXT_WORDS))).alias("has"), F.bool_or(F.lower("field").rlike("metric|score|value")).alias("metric"), F.max("ordinal").alias("ordinal"))
    added = tables.where("metric and not has").select("table_name", F.lit("condition").alias("field"), F.lit("string").alias("type"), F.lit(False).alias("required"), F.lit(False).alias("evidence_required"), (F.col("ordinal") + 1).alias("ordinal"))
    return kept.unionByName(added.select(*kept.columns))


def typed(kind: Column, value: Column) -> Column:
    """(json, event): a JSON value in its declared type, and how it was brought there (null if it was).

    Types are ``string``, ``number``, ``integer``, ``boolean``, ``list`` (any of ``list[...]``) and ``object``, null allowed in all.
    What cannot be converted stays as it is.
    """
    have, plain = json_kind(value), json_plain(value)
    want = F.regexp_extract(F.lower(kind), r"^(list|string|number|integer|int|float|boolean|bool|object|dict)", 1)
    text = F.trim(plain)
    made = lambda json, event: F.struct(json.alias("json"), F.lit(event).cast("string").alias("event"))
    quoted = F.regexp_replace(F.to_json(F.array(plain)), r"^\[|\]$", "")
    is_list, is_object = want == "list", want.isin("object", "dict")
    looks_list, looks_object = text.rlike(r"(?s)^\[.*\]$") & F.from_json(plain, "array<string>").isNotNull(), text.rlike(r"(?s)^\{.*\}$") & F.from_json(plain, "map<string,string>").isNotNull()
    return (
        F.when(is_list & (have == "null"), made(F.lit("[]"), "null_to_empty_list"))
        .when(is_object & (have == "null"), made(F.lit("{}"), "null_to_empty_dict"))
        .when(is_list & (have == "string") & looks_list, made(text, "json_text_to_list"))
        .when(is_object & (have == "string") & looks_object, made(text, "json_text_to_dict"))
        .when(is_list & (have != "array"), made(F.concat(F.lit("["), value, F.lit("]")), "scalar_to_list"))
        .when(want.isin("boolean", "bool") & (have == "string") & F.lower(text).isin(*TRUE_WORDS), made(F.lit("true"), "string_to_bool"))
        .when(want.isin("boolean", "bool") & (have == "string") & F.lower(text).isin(*FALSE_WORDS), made(F.lit("false"), "string_to_bool"))
        .when(want.isin("integer", "int") & (have == "string") & text.rlike(r"^[+-]?\d+$"), made(text.try_cast("bigint").cast("string"), "numeric_string_to_int"))
        .when(want.isin("number", "float") & (have == "string") & text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), made(text, "numeric_string_to_float"))
        .when((want == "string") & ~have.isin("string", "null"), made(quoted, "value_to_string"))
        .otherwise(made(F.coalesce(value, F.lit("null")), None))
    )


def conform(payloads: DataFrame, plan: DataFrame) -> DataFrame:
    """Payloads of planned tables: fields in their declared types, others under ``extra``, warnings for what is missing.

    Adds ``events`` (field, event). If the plan has one context field that the payload lacks and the payload has one context
    field that the plan lacks, that value is taken over. Payloads of tables that the plan doesn't have are dropped.
    """
    spec = plan.groupBy("table_name").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "type")))).alias("_types"), F.array_sort(F.collect_set(F.when(F.col("required"), F.col("field")))).alias("_required")
    )
    met = payloads.join(F.broadcast(spec), "table_name")
    known, own = F.map_keys("_types"), F.map_keys("fields")
    wanted = F.array_except(F.array_intersect(known, F.array(*map(F.lit, CONTEXT_NAMES))), own)
    offered = F.array_except(F.array_intersect(own, F.array(*map(F.lit, CONTEXT_NAMES))), known)
    met = met.withColumn("_swap", F.when((F.size(wanted) == 1) & (F.size(offered) == 1), F.struct(offered[0].alias("was"), wanted[0].alias("now"))))
    renamed = F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.when(e["key"] == F.col("_swap.was"), F.col("_swap.now")).otherwise(e["key"]), e["value"])))
    met = met.withColumn("fields", renamed)
    each = F.transform(
        F.filter(F.map_entries("fields"), lambda e: F.map_contains_key("_types", e["key"])),
        lambda e: F.struct(e["key"].alias("field"), typed(F.element_at("_types", e["key"]), e["value"]).alias("t")),
    )
    met = met.withColumns({"_each": each, "extra": F.map_filter("fields", lambda k, _: ~F.map_contains_key("_types", k))})
    met = met.withColumn("fields", F.map_from_entries(F.transform("_each", lambda x: F.struct(x["field"], x["t"]["json"]))))
    absent = F.filter(F.coalesce("_required", F.array().cast("array<string>")), lambda n: ~json_present(F.element_at("fields", n)))
    warnings = F.array_distinct(F.concat("warnings", F.transform(absent, lambda n: F.concat(F.lit(REQUIRED_MISSING), n))))
    events = F.transform(F.filter("_each", lambda x: x["t"]["event"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), x["t"]["event"].alias("event")))
    return met.withColumns({"warnings": warnings, "events": events}).drop("_types", "_required", "_swap", "_each")


def fix_page(records: DataFrame) -> DataFrame:
    """A record's page is that of its block (``block_page``); a page that differed gets a warning."""
    differs = F.col("block_page").isNotNull() & F.col("page").isNotNull() & (F.col("page") != F.col("block_page"))
    warned = F.when(differs, F.array_append("warnings", F.lit("page corrected to the page of the source block"))).otherwise(F.col("warnings"))
    return records.withColumns({"warnings": warned, "page": F.coalesce("block_page", "page")}).drop("block_page")


# Names of source types, connectors and decisions by their other spellings.
ALIASES = {
    "source_type": {
        "article": "paper", "papers": "paper", "publication": "paper", "preprint": "paper", "journal_article": "paper", "datasets": "dataset", "data": "dataset", "database": "open_database",
        "db": "open_database", "repo": "repository", "code": "repository", "github": "repository", "supplement": "supplementary_material", "supplementary": "supplementary_material", "si": "supplementary_material", "tables": "table", "figure": "image", "figures": "image", "images": "image",
    },
    "connector": {"arxiv.org": "arxiv", "open_alex": "openalex", "s2": "semantic_scholar", "semanticscholar": "semantic_scholar", "cross_ref": "crossref", "git_hub": "github", "fig_share": "figshare"},
    "decision": {
        "download_pdf": "deep_read", "read_pdf": "deep_read", "full_read": "deep_read", "ingest": "deep_read", "metadata": "metadata_only", "abstract_only": "metadata_only", "readme": "read_readme",
        "manifest": "read_file_manifest", "skip": "reject", "ignore": "reject", "discard": "reject", "ask": "ask_user", "confirm": "ask_user",
    },
    "priority": {"critical": "high", "urgent": "high", "normal": "medium", "moderate": "medium", "optional": "low", "minor": "low"},
}


def canonical(kind: str, value: Column) -> Column:
    """The canonical name of a source type, connector, decision or priority; unknown ones stay, in lower case with underscores."""
    key = F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ALIASES[kind].items() for x in p)), key), key)
