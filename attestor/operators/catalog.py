"""The catalogue of sources and their artifacts: joins of what was found, chosen, read and parsed, and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import stable_id
from attestor.functions.text import basename, location
from attestor.operators.common import first_per_key

# Successful states of an artifact in order; states that an update never takes back.
STATUS_ORDER = ("inspected", "downloaded", "parsed")
FINAL = ("parsed", "skipped", "failed")
# Kinds of artifact by file ending.
SUFFIX_KINDS = {
    ".pdf": "pdf",
    ".html": "html",
    ".htm": "html",
    ".csv": "csv",
    ".tsv": "tsv",
    ".xlsx": "xlsx",
    ".xls": "xlsx",
    ".json": "json",
    ".xml": "xml",
    ".zip": "code_archive",
    ".tar": "code_archive",
    ".gz": "code_archive",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".svg": "image",
    ".fits": "fits",
}


def artifact_kind(name: Column, fallback: str = "unknown") -> Column:
    """The kind of an artifact by its ending; ``readme`` by its name."""
    base = F.lower(basename(F.regexp_replace(name, r"[?#].*$", "")))
    suffix = F.regexp_extract(base, r"(\.[a-z0-9]+)$", 1)
    table = F.create_map(*(F.lit(x) for pair in SUFFIX_KINDS.items() for x in pair))
    return F.when(F.startswith(base, F.lit("readme")), "readme").otherwise(F.coalesce(F.element_at(table, suffix), F.lit(fallback)))


def with_decisions(sources: DataFrame, selections: DataFrame, triaged: DataFrame) -> DataFrame:
    """Left lookups of the selection and the triage of each source; relevance is the triage's, else the selection's, else the confidence."""
    a = selections.select("source_id", F.col("decision").alias("selection_action"), F.col("priority_score").alias("_priority"))
    b = triaged.select("source_id", F.col("action").alias("triage_action"), F.col("score").alias("_score"))
    met = sources.join(a, "source_id", "left").join(b, "source_id", "left")
    return met.withColumn("relevance_score", F.coalesce("_score", "_priority", "confidence")).drop("_score", "_priority")


def insight_counts(sources: DataFrame, insights: DataFrame) -> DataFrame:
    """Sources with the number of their insights and the distinct types in order; 0 and an empty list without any."""
    counted = insights.groupBy("source_id").agg(F.count("*").alias("insights"), F.array_sort(F.collect_set("insight_type")).alias("insight_types"))
    met = sources.join(counted, "source_id", "left")
    return met.withColumns({"insights": F.coalesce("insights", F.lit(0)), "insight_types": F.coalesce("insight_types", F.array().cast("array<string>"))})


def parsed_paths(*tables: DataFrame) -> DataFrame:
    """Distinct paths of texts, tables and figures, in the form in which paths are compared."""
    out = None
    for table in tables:
        paths = table.where("source_path <> ''").select(location(F.col("source_path")).alias("path"))
        out = paths if out is None else out.unionByName(paths)
    return out.distinct()


def parsed_artifacts(artifacts: DataFrame, paths: DataFrame) -> DataFrame:
    """Artifacts whose file was parsed."""
    return artifacts.join(paths, location(F.col("local_path")) == F.col("path"), "left_semi")


def unlisted_files(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files that no artifact of the catalogue stands for."""
    known = artifacts.where("local_path <> ''").select(location(F.col("local_path")).alias("_p"))
    return files.join(known, location(F.col("path")) == F.col("_p"), "left_anti")


def new_blocks(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks whose (source_file, page, text) is not known yet; a missing page equals a missing page."""
    key = lambda: F.struct("source_file", "page", F.sha2("text", 256).alias("digest"))
    b, k = blocks.withColumn("_k", key()), known.select(key().alias("_o"))
    return b.join(k, F.col("_k").eqNullSafe(F.col("_o")), "left_anti").drop("_k")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def prefer_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections, and text blocks of the files without any."""
    return sections.unionByName(blocks.join(sections.select("source_file").distinct(), "source_file", "left_anti"), allowMissingColumns=True)


def flatten(catalog: DataFrame) -> DataFrame:
    """One row for each artifact; a source without any keeps one row."""
    return catalog.select(*(c for c in catalog.columns if c != "artifacts"), F.explode_outer("artifacts").alias("a")).select("*", "a.*").drop("a")


def identity(source_id: Column, url: Column, local_path: Column, kind: Column, name: Column) -> Column:
    """What makes an artifact the same across updates: its URL, else its path, else its kind and name."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(some(url), F.struct(source_id.alias("s"), F.lit("url").alias("k"), url.alias("v")))
        .when(some(local_path), F.struct(source_id.alias("s"), F.lit("local").alias("k"), location(local_path).alias("v")))
        .otherwise(F.struct(source_id.alias("s"), F.lit("named").alias("k"), F.concat_ws("|", kind, name).alias("v")))
    )


def _rank(status: Column) -> Column:
    choice = None
    for i, s in enumerate(STATUS_ORDER, 1):
        choice = F.when(status == s, i) if choice is None else choice.when(status == s, i)
    return choice.otherwise(0)


def merge_state(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Current artifacts with what an earlier state knew of them.

    Both have (source_id, url, local_path, artifact_type, name, status, completed_operations). Final states of the
    prior stay; of the others the more advanced holds. Operations are united in order; a path that was known stays known.
    """
    key = identity(F.col("source_id"), F.col("url"), F.col("local_path"), F.col("artifact_type"), F.col("name"))
    old = first_per_key(prior.withColumn("_k", key), ["_k"], [-_rank(F.col("status")), F.col("status")])
    old = old.select(F.col("_k").alias("_ok"), F.col("status").alias("_s"), F.col("local_path").alias("_p"), F.col("completed_operations").alias("_c"))
    met = current.withColumn("_k", key).join(old, F.col("_k") == F.col("_ok"), "left")
    status = F.when(F.col("_s").isin(*FINAL) | (_rank(F.col("_s")) > _rank(F.col("status"))), F.col("_s")).otherwise(F.col("status"))
    done = F.array_distinct(F.concat("completed_operations", F.coalesce("_c", F.array().cast("array<string>"))))
    return met.withColumns({"status": status, "local_path": F.coalesce(F.nullif("local_path", F.lit("")), "_p"), "completed_operations": done}).drop("_k", "_ok", "_s", "_p", "_c")


def upsert_state(prior: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a batch of artifacts: new ones are added, known ones merged by the rules of :func:`merge_state`, all others stay.

    Of several rows of one artifact in a batch the most advanced counts; their operations are united. ``prior`` is what an earlier batch left, so it has one row an artifact.
    A batch is shuffled once, and the state once, by an identity that is worked out where rows are dealt and goes with none of the state's rows.
    """
    key = identity(F.col("source_id"), F.col("url"), F.col("local_path"), F.col("artifact_type"), F.col("name"))
    columns = batch.columns
    all_done = F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("completed_operations")))))
    best = F.min_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.struct(-_rank(F.col("status")), "status"))
    grouped = batch.groupBy(key.alias("_k")).agg(best.alias("_row"), all_done.alias("_all"))
    done = F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.col("_row.completed_operations"))
    if prior is None:
        return grouped.select(*((done if c == "completed_operations" else F.col(f"_row.`{c}`")).alias(c) for c in columns))
    old = lambda c: F.col(f"_old.`{c}`")
    met = prior.select(F.struct(*(F.col(f"`{c}`") for c in prior.columns)).alias("_old"))
    known = identity(*(old(c) for c in ("source_id", "url", "local_path", "artifact_type", "name")))
    met = met.join(grouped, known == F.col("_k"), "full_outer")
    new = lambda c: F.col(f"_row.`{c}`")
    advanced = old("status").isin(*FINAL) | (_rank(old("status")) > _rank(new("status")))
    merged = {
        "status": F.when(advanced, old("status")).otherwise(new("status")),
        "local_path": F.coalesce(F.nullif(new("local_path"), F.lit("")), old("local_path")),
        "completed_operations": F.array_distinct(F.concat(done, F.coalesce(old("completed_operations"), F.array().cast("array<string>")))),
    }
    return met.select(*(F.when(F.col("_row").isNull(), old(c)).otherwise(merged.get(c, new(c))).alias(c) for c in columns))


def entry_status(artifacts: DataFrame) -> DataFrame:
    """(source_id, status): the most advanced state of a source's artifacts, null if none has one."""
    best = artifacts.groupBy("source_id").agg(F.max(_rank(F.col("status"))).alias("r"))
    names = F.array(*map(F.lit, STATUS_ORDER))
    return best.select("source_id", F.when(F.col("r") > 0, F.get(names, F.col("r") - 1)).alias("status"))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of several columns occurs, in one pass with grouping sets."""
    from functools import reduce

    counted = rows.groupingSets([[F.col(c)] for c in columns], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # the set of a row is told by its grouping bits: all are set but that of its own column
    full = (1 << len(columns)) - 1
    which = reduce(lambda c, i: c.when(F.col("g") == full - (1 << (len(columns) - 1 - i)), F.lit(columns[i])), range(len(columns)), F.when(F.lit(False), F.lit("")))
    value = F.coalesce(*(F.col(c).cast("string") for c in columns))
    return counted.select(which.alias("column"), value.alias("value"), "n")


def connector_usability(runs: DataFrame) -> DataFrame:
    """(connector, usable, statuses, first_error) from (connector, status, error, ordinal): the first four states and the first error."""
    heads = runs.groupBy("connector").agg(
        F.bool_or(F.col("status").isin("completed", "partial")).alias("usable"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ordinal"))).alias("first_error")
    )
    from pyspark.sql import Window

    ranked = runs.withColumn("_n", F.row_number().over(Window.partitionBy("connector").orderBy("ordinal"))).where("_n <= 4")  # a top-k a group: cut before the shuffle
    first = ranked.groupBy("connector").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "status"))), lambda s: s["status"]).alias("statuses"))
    return heads.join(first, "connector")


def run_status(runs: DataFrame) -> DataFrame:
    """One row: ``completed`` if all connectors are, ``failed`` if all failed, ``skipped`` without any, else ``partial``."""
    counted = runs.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    return counted.select(F.when(F.col("n") == 0, "skipped").when(F.col("done") == F.col("n"), "completed").when(F.col("failed") == F.col("n"), "failed").otherwise("partial").alias("status"), "n", "done", "failed", "found")


def fill_from_history(current: DataFrame, history: DataFrame, total: int) -> DataFrame:
    """Current sources, filled up to ``total`` by the best of history whose URL is not among them.

    History is ordered by fewest warnings, then highest confidence, and then by id.
    """
    fresh = history.join(current.select("url").distinct(), "url", "left_anti")
    room = current.agg(F.greatest(F.lit(0), F.lit(total) - F.count("*")).alias("_room"))
    best = fresh.orderBy("warning_count", F.desc("confidence"), "source_id").limit(total)
    from pyspark.sql import Window

    placed = best.withColumn("_at", F.row_number().over(Window.orderBy("warning_count", F.desc("confidence"), "source_id")))  # at most ``total`` rows
    return current.unionByName(placed.crossJoin(F.broadcast(room)).where("_at <= _room").drop("_at", "_room"), allowMissingColumns=True)


def artifact_id(source_id: Column, kind: Column, url: Column, local_path: Column) -> Column:
    return stable_id("artifact", source_id, kind, url, F.when(url.isNull(), local_path))
