"""Triage: what to do with a found source before anything is downloaded.

A source has ``source_id, ordinal, title, description, reason, query, url, source_type, confidence, provider, pdf_url,
keywords ARRAY<STRING>, files ARRAY<STRUCT<name, type, size BIGINT>>, size BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.labels import relevance, topic_tokens
from attestor.operators.common import first_per_key

SMALL, MEDIUM = 10 * 1024 * 1024, 50 * 1024 * 1024

# File types, providers, source types and actions that the rules know.
TABLE_FILES = (".csv", ".tsv", ".xlsx", ".xls", ".json", ".xml")
DOCUMENT_FILES = (".pdf", ".txt", ".md")
PAPER_PROVIDERS = ("arxiv", "openalex", "semantic_scholar")
INDEX_PROVIDERS = ("arxiv", "openalex", "semantic_scholar", "crossref")
DATA_TYPES = ("dataset", "open_database", "supplementary_material", "table", "image")
PAPER_TYPES = ("paper", "paper_metadata", "paper_search")
RESOURCE_ACTIONS = ("download_pdf", "download_small_table", "download_small_supplement", "read_readme")
TOPIC_GUARDS = (("perovskite", "钙钛矿"),)
RISKY_NOTES = ("large", "too big", "paywall", "403", "unclear", "stale", "off-topic", "uncertain")


def extension(file: Column) -> Column:
    """The ending of a file's name, else of its type, else empty."""
    named = F.regexp_extract(F.lower(F.coalesce(file["name"], F.lit(""))), r"(\.[a-z0-9]+)(?:$|\?)", 1)
    kind = F.concat(F.lit("."), F.lower(F.coalesce(file["type"], F.lit(""))))
    return F.when(named != "", named).when(kind.isin(*TABLE_FILES, *DOCUMENT_FILES), kind).otherwise("")


def best_small_file(files: Column) -> Column:
    """The file to take: no larger than 10 MiB or of unknown size, tables before documents, small before large."""
    ranked = F.transform(
        files,
        lambda f, i: F.struct(
            F.when(extension(f).isin(*TABLE_FILES), 0).when(extension(f).isin(*DOCUMENT_FILES), 1).alias("rank"), F.coalesce(f["size"], F.lit(0)).alias("bytes"), i.alias("nth"), f["size"].alias("size"), extension(f).alias("ext")
        ),
    )
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull() & (r["bytes"] <= SMALL)))


def total_size(files: Column, size: Column) -> Column:
    """Sum of the known sizes of the files; without a file list the size of the source."""
    sizes = F.filter(F.transform(files, lambda f: f["size"]), lambda s: s.isNotNull())
    summed = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, s: a + s))
    return F.when(files.isNotNull(), summed).otherwise(size)


def cost(size: Column) -> Column:
    return F.when(size.isNull(), "unknown").when(size <= SMALL, "low").when(size <= MEDIUM, "medium").otherwise("high")


def manifest_decision(files: Column) -> Column:
    """(action, ingest, risk, size) for a source with a list of files."""
    best = best_small_file(files)
    whole = total_size(files, F.lit(None).cast("bigint"))
    made = lambda action, ingest, risk, size: F.struct(F.lit(action).alias("action"), F.lit(ingest).alias("ingest"), F.lit(risk).alias("risk"), size.cast("bigint").alias("size"))
    return (
        F.when(F.coalesce(F.size(files), F.lit(0)) <= 0, made("read_file_manifest", False, "low", F.lit(None)))
        .when(best.isNull() & (whole > MEDIUM), made("ask_user", False, "high", whole))
        .when(best.isNull(), made("read_file_manifest", False, "medium", whole))
        .when(best["rank"] == 0, made("download_small_table", True, "low", best["size"]))
        .otherwise(made("download_small_supplement", True, "low", best["size"]))
    )


def scored(sources: DataFrame, question: str) -> DataFrame:
    """Add ``score``: the fit of each source to a question."""
    text = F.concat_ws(" ", "title", "description", "reason", "query", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    return sources.withColumn("score", relevance(F.col("confidence"), topic_tokens(F.lit(question)), topic_tokens(text), F.col("provider")))


def take_best(rows: DataFrame, eligible: Column, order: list[Column], budget: int | None) -> DataFrame:
    """Add ``taken``: whether a row is eligible and among the best ``budget`` of those (all without a budget).

    The best are found by a top-k, whose result is as small as the budget and is broadcast to the rows.
    """
    if budget is None or budget <= 0:
        return rows.withColumn("taken", F.coalesce(eligible, F.lit(False)))
    best = rows.where(eligible).orderBy(*order).limit(budget).select("source_id").distinct().withColumn("_in", F.lit(True))
    return rows.join(F.broadcast(best), "source_id", "left").withColumn("taken", F.coalesce(F.col("_in") & eligible, F.lit(False))).drop("_in")


def triage(sources: DataFrame, question: str, max_pdfs: int | None = None) -> DataFrame:
    """(source_id, provider, score, action, ingest, cost, risk, size) by fixed rules, papers within a budget by their score."""
    provider, pdf = F.lower(F.trim("provider")), F.coalesce("pdf_url", F.lit("")) != ""
    paper = provider.isin(*PAPER_PROVIDERS) & pdf
    rows = take_best(scored(sources, question), paper, [F.desc("score"), F.col("ordinal")], max_pdfs)
    files = manifest_decision(F.col("files"))
    hosted = F.coalesce(provider.isin("zenodo", "figshare"), F.lit(False))
    action = (
        F.when(paper & F.col("taken"), "download_pdf")
        .when(provider.isin(*INDEX_PROVIDERS) & (paper | (provider != "arxiv")), "read_metadata")
        .when(provider == "github", "read_readme")
        .when(hosted, files["action"])
        .when(F.col("source_type").isin(*DATA_TYPES), "read_file_manifest")
        .otherwise("record_only")
    )
    size = F.when(hosted, files["size"]).otherwise(total_size(F.col("files"), F.col("size")))
    return rows.select(
        "source_id", provider.alias("provider"), F.round("score", 4).alias("score"), action.alias("action"), ((action == "download_pdf") | (hosted & files["ingest"])).alias("ingest"),
        F.when(action == "download_pdf", "medium").otherwise(cost(size)).alias("cost"), F.when(hosted, files["risk"]).otherwise("low").alias("risk"), size.alias("size"),
    )


def off_topic(question: str, text: Column) -> Column:
    """Whether the question names a guarded topic that a text lacks."""
    lost = F.lit(False)
    for terms in TOPIC_GUARDS:
        if any(t in question.casefold() for t in terms):
            lost = lost | ~F.lower(text).rlike("|".join(terms))
    return lost


def best_selections(decisions: DataFrame) -> DataFrame:
    """One selection a source over all batches: the highest priority score, the earliest of equals."""
    return first_per_key(decisions, ["source_id"], [-F.col("priority_score"), F.col("ordinal")])


def _selection_order() -> list[Column]:
    boost = F.when(F.col("priority") == "high", 1.0).when(F.col("priority") == "low", 0.0).otherwise(0.5)
    role = F.col("source_role")
    roles = (
        F.when(role == "primary_paper", 0.3).when(role == "dataset", 0.2).when(role.isin("supplementary_material", "image"), 0.15).when(role == "supporting_paper", 0.1).when(role == "noise", -0.5).otherwise(0.0)
    )
    return [F.desc("priority_score"), F.desc(boost + roles), F.desc("confidence"), F.col("ordinal")]


def triage_selected(sources: DataFrame, selections: DataFrame, question: str = "", max_pdfs: int | None = None, max_resources: int | None = None) -> DataFrame:
    """(source_id, score, action, ingest, risk, deferred) from selections that a model or a person made.

    ``selections`` has (source_id, decision, priority, priority_score, source_role, risk_notes ARRAY<STRING>). Decisions
    that a source cannot carry are brought down to what it can. Sources without one, and those off topic, are skipped. Reads
    and downloads beyond ``max_resources`` are deferred, the least relevant first.
    """
    provider, pdf = F.lower(F.trim("provider")), F.coalesce("pdf_url", F.lit("")) != ""
    met = sources.join(selections, "source_id", "left")
    deep = (F.col("decision") == "deep_read") & pdf & provider.isin(*PAPER_PROVIDERS)
    met = take_best(met, deep, _selection_order(), max_pdfs)
    files, decision = manifest_decision(F.col("files")), F.col("decision")
    notes = F.lower(F.array_join(F.coalesce("risk_notes", F.array().cast("array<string>")), " "))
    own_risk = F.when(notes.rlike("|".join(RISKY_NOTES)), 1).otherwise(0)
    file_risk = F.when(files["risk"] == "high", 2).when(files["risk"] == "medium", 1).otherwise(0)
    small, data = decision.isin("download_small_table", "download_small_supplement"), F.col("source_type").isin(*DATA_TYPES)
    lost = off_topic(question, F.concat_ws(" ", "title", "description", "reason"))
    action = (
        F.when(lost | decision.isNull() | (decision == "reject"), "skip")
        .when(decision == "ask_user", "ask_user")
        .when(decision == "metadata_only", F.when(provider.isin(*INDEX_PROVIDERS), "read_metadata").otherwise("record_only"))
        .when(decision == "read_readme", F.when(provider == "github", "read_readme").otherwise("record_only"))
        .when(decision == "read_file_manifest", "read_file_manifest")
        .when(small, files["action"])
        .when((decision == "deep_read") & deep, F.when(F.col("taken"), "download_pdf").otherwise("read_metadata"))
        .when((decision == "deep_read") & provider.isin(*INDEX_PROVIDERS), "read_metadata")
        .when((decision == "deep_read") & (provider == "github"), "read_readme")
        .when((decision == "deep_read") & data, files["action"])
        .otherwise("record_only")
    )
    by_files = small | ((decision == "deep_read") & data & ~provider.isin(*INDEX_PROVIDERS, "github"))
    unread = (decision == "deep_read") & provider.isin(*INDEX_PROVIDERS) & ~deep
    risk = F.when(lost | decision.isNull(), 0).when(decision == "ask_user", 2).when(by_files, F.greatest(own_risk, file_risk)).when(unread, F.greatest(own_risk, F.lit(1))).otherwise(own_risk)
    ingest = (action == "download_pdf") | (by_files & action.isin("download_small_table", "download_small_supplement"))
    rows = met.select(
        "source_id", "ordinal", "confidence", provider.alias("provider"), "source_type", "priority", F.when(lost | decision.isNull(), 0.0).otherwise(F.round("priority_score", 4)).alias("score"),
        action.alias("action"), ingest.alias("ingest"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), risk + 1).alias("risk"),
    )
    return cap_resources(rows, max_resources)


def cap_resources(rows: DataFrame, most: int | None) -> DataFrame:
    """Keep the best ``most`` reads and downloads (all without a cap); the others are deferred to a cheaper action."""
    counts = F.col("action").isin(*RESOURCE_ACTIONS) & (F.col("ingest") | (F.col("action") == "read_readme"))
    boost = F.when(F.col("action") == "download_pdf", 0.3).when(F.col("action") == "download_small_table", 0.25).when(F.col("action") == "download_small_supplement", 0.2).otherwise(0.1)
    wish = F.when(F.col("priority") == "high", 0.2).when(F.col("priority") == "medium", 0.1).otherwise(0.0)
    marked = take_best(rows, counts, [F.desc("score"), F.desc(boost + wish), F.desc("confidence"), F.col("ordinal")], most)
    deferred = counts & ~F.col("taken")
    cheaper = F.when(F.col("provider").isin(*INDEX_PROVIDERS), "read_metadata").when(F.col("source_type").isin(*DATA_TYPES), "read_file_manifest").otherwise("record_only")
    marked = marked.withColumn("deferred", deferred)
    return marked.select(
        "source_id", "score", F.when(F.col("deferred"), cheaper).otherwise(F.col("action")).alias("action"), (F.col("ingest") & ~F.col("deferred")).alias("ingest"), "risk", "deferred"
    )


def fallback_score(source_type: Column, confidence: Column, citations: Column) -> Column:
    """Confidence, 0.1 for a paper, and up to 0.2 for citations."""
    boost = F.when(source_type.isin(*PAPER_TYPES), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence + boost + F.least(F.lit(0.2), F.coalesce(citations, F.lit(0)) / 1000.0))), 4)


def replacements(sources: DataFrame, attempted: DataFrame, failed: int, multiplier: int = 3) -> DataFrame:
    """Papers to try after ``failed`` downloads: the best not yet attempted and not rejected, ``multiplier`` for each failure."""
    open_ = sources.where((F.coalesce("pdf_url", F.lit("")) != "") & F.lower(F.trim("provider")).isin(*INDEX_PROVIDERS) & (F.lower(F.coalesce("selection_decision", F.lit(""))) != "reject"))
    left = open_.join(attempted.select("source_id").distinct(), "source_id", "left_anti")
    ranked = left.withColumn("score", fallback_score(F.col("source_type"), F.col("confidence"), F.col("citation_count")))
    return ranked.orderBy(F.desc("score"), F.desc(F.coalesce("citation_count", F.lit(0))), F.desc("confidence"), F.desc(F.lower("title"))).limit(max(1, failed) * max(1, multiplier))


def ingestible(decisions: DataFrame, provider: str | None = None) -> DataFrame:
    """Sources whose PDF is to be downloaded, of one provider if it is named."""
    chosen = decisions.where("action = 'download_pdf' and ingest")
    return chosen.where(F.col("provider") == provider) if provider else chosen
