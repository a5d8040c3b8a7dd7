"""From a question to requests, and from decisions to what is read: domain, keywords, search plans, ingestion routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import squeeze
from attestor.functions.values import is_present
from attestor.operators.common import first_per_key
from attestor.sources.files import insight_blocks

PREVIEW = 1200

# Words by which the domain of a question is told, the first domain that fits.
DOMAIN_WORDS = (
    ("astronomy", ("supernova", "ia 型", "光变", "light curve", "photometry", "redshift", "天文")),
    ("materials science", ("perovskite", "pce", "材料", "catalyst", "bandgap", "stability")),
    ("machine learning", ("model", "dataset", "benchmark", "fid", "lpips", "accuracy", "tryon", "try-on", "try on", "virtual try", "vton", "虚拟试衣", "试穿", "机器学习")),
    ("biomedicine", ("drug", "cell", "gene", "clinical", "ic50", "biomedical", "生物", "药物")),
    ("chemistry", ("compound", "reaction", "yield", "spectrum", "chemistry", "化学")),
    ("environmental science", ("pm2.5", "climate", "pollution", "气象", "环境")),
)
OTHER_DOMAIN = "general science"
# Keywords that every question gets, and captions of figures and tables.
COMMON_KEYWORDS = ("dataset", "supplementary data", "table", "open database")
CAPTION = r"(?i)^\s*(fig(?:ure)?\.?|table|tab\.?)\s*([0-9]+[A-Za-z]?)\s*[.:|-]?\s*(.*)$"


def domain(text: Column) -> Column:
    """The domain of a question by its words."""
    lower, choice = F.lower(text), None
    for name, words in DOMAIN_WORDS:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(lower, w))
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return choice.otherwise(OTHER_DOMAIN)


def keywords(question: Column, extra: Column | None = None) -> Column:
    """The question, the keywords of its domain if given, and the common ones, each once."""
    parts = [F.array(question), *([extra] if extra is not None else []), F.array(*map(F.lit, COMMON_KEYWORDS))]
    return F.array_distinct(F.concat(*parts))


def assign_groups(requests: DataFrame, groups: DataFrame) -> DataFrame:
    """Requests with the field group that they serve: by its id, else by a field in common, else by a field named in the text.

    ``requests`` has (request_id, connector, query, purpose, group_id, fields ARRAY<STRING>), ``groups`` (group_id, field).
    Each way holds only if exactly one group fits; a request without one keeps a null group. Groups are as few as a plan's tables.
    """
    plan = groups.select(F.lower(F.trim("group_id")).alias("_g"), F.lower(F.trim("field")).alias("_f")).where("_g <> '' and _f <> ''").distinct()
    plan = plan.groupBy("_g").agg(F.array_sort(F.collect_set("_f")).alias("_fields"))
    text = F.lower(F.concat_ws(" ", "query", "purpose"))
    own = F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    one = plan.agg(F.array_sort(F.collect_list(F.struct("_g", "_fields"))).alias("_groups"))  # one row, as large as the plan
    met = requests.withColumns({"_id": F.lower(F.trim("group_id")), "_own": own, "_text": text}).crossJoin(F.broadcast(one))
    fits = (
        F.filter("_groups", lambda g: g["_g"] == F.col("_id")),
        F.filter("_groups", lambda g: F.arrays_overlap(F.col("_own"), g["_fields"])),
        F.filter("_groups", lambda g: F.exists(g["_fields"], lambda f: F.contains(F.col("_text"), F.replace(f, F.lit("_"), F.lit(" "))))),
    )
    first = F.when(F.size(fits[0]) > 0, fits[0]).when(F.size(fits[1]) > 0, fits[1]).otherwise(fits[2])
    return met.withColumn("_fit", first).withColumn("group_id", F.when(F.size("_fit") == 1, F.col("_fit")[0]["_g"])).drop("_id", "_own", "_text", "_groups", "_fit")


def missing_requests(assigned: DataFrame, groups: DataFrame, question: str) -> DataFrame:
    """One request for each field group that none serves: the question, the group's label and its first eight fields."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "field"))), lambda f: f["field"])
    wanted = groups.groupBy(F.lower(F.trim("group_id")).alias("group_id"), "label").agg(ordered.alias("fields"))
    left = wanted.join(assigned.where("group_id is not null").select("group_id").distinct(), "group_id", "left_anti")
    named = F.array_join(F.transform(F.slice("fields", 1, 8), lambda f: F.replace(f, F.lit("_"), F.lit(" "))), " ")
    return left.select("group_id", F.lit("openalex").alias("connector"), F.concat_ws(" ", squeeze(F.lit(question)), "label", named).alias("query"), "fields")


def merge_requests(plans: list[DataFrame]) -> DataFrame:
    """Requests of several plans, each (connector, query, group) once, the first plan's."""
    rows = None
    for i, plan in enumerate(plans):
        part = plan.withColumn("_plan", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    key = [F.lower("connector"), F.lower(squeeze(F.col("query"))), F.lower(F.coalesce("group_id", F.lit("")))]
    return first_per_key(rows, key, [F.col("_plan"), F.col("query")]).drop("_plan")


def ingest_routes(decisions: DataFrame) -> DataFrame:
    """Add ``route`` to triage decisions (action, provider, url): what reading a source comes to.

    Skipped sources have none; papers of the arXiv wait for its own downloader; a download without a URL is an error.
    """
    downloads = F.col("action").isin("download_pdf", "download_small_table", "download_small_supplement")
    route = (
        F.when(F.col("action") == "skip", F.lit(None))
        .when(F.col("action") == "read_readme", "readme")
        .when(F.col("action") == "read_file_manifest", "manifest")
        .when(downloads & (F.col("provider") == "arxiv"), "deferred")
        .when(downloads & ~is_present(F.col("url")), "error")
        .when(downloads, "download")
        .otherwise("metadata")
    )
    return decisions.withColumn("route", route)


def ingest(decisions: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(insights, text blocks) of decisions; ``texts`` has (source_id, insight_type, text), what readers brought.

    Every source that is not skipped gives its metadata as an insight, and the texts of its route.
    """
    routed = ingest_routes(decisions).where("route is not null")
    about = routed.select("source_id", F.lit("metadata").alias("insight_type"), F.to_json(F.struct(*(c for c in ("title", "provider", "action", "url") if c in decisions.columns))).alias("text"))
    kind = F.when(F.col("route") == "error", "ingestion_error").otherwise(F.col("route"))
    read = routed.select("source_id", kind.alias("insight_type")).join(texts, ["source_id", "insight_type"])
    failed = routed.where("route = 'error'").select("source_id", F.lit("ingestion_error").alias("insight_type"), F.lit("There is no URL to download from.").alias("text"))
    insights = about.unionByName(read).unionByName(failed)
    return insights, insight_blocks(insights)


def source_rows(sources: DataFrame) -> DataFrame:
    """Sources as flat rows for people: the first of synonymous metadata fields, nested values as JSON text.

    ``sources`` has (source_id, title, source_type, url, confidence, metadata MAP<STRING, JSON text>).
    """
    from attestor.functions.values import json_plain, json_present

    def first(*names: str) -> Column:
        return F.coalesce(*(F.when(json_present(F.element_at("metadata", n)), json_plain(F.element_at("metadata", n))) for n in names))

    return sources.select(
        "source_id", "title", "source_type", "url", "confidence", first("provider").alias("provider"), first("doi", "DOI").alias("doi"), first("publication_year", "year").alias("year"), first("authors", "creators").alias("authors"),
        first("citation_count", "citationCount").alias("citations"), first("pdf_url", "open_access_url").alias("pdf_url"), F.to_json("metadata").alias("metadata"),
    )


def section_payload(sections: DataFrame) -> DataFrame:
    """Sections without their text: its length and its first 1200 characters."""
    return sections.withColumns({"chars": F.length("text"), "preview": F.left("text", F.lit(PREVIEW))}).drop("text")


def combined_metadata(records: DataFrame) -> DataFrame:
    """(source_id, metadata, urls, paths): provider records of a source as one view.

    ``records`` has (source_id, ordinal, metadata MAP<STRING, STRING>, urls ARRAY<STRING>, paths ARRAY<STRING>). The first value of a key
    holds; URLs and paths are united in order, each once.
    """
    values = records.select("source_id", "ordinal", F.explode("metadata").alias("name", "value")).where("value <> ''")
    values = values.groupBy("source_id", "name").agg(F.min_by("value", "ordinal").alias("value"))
    views = values.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metadata"))

    def united(column: str) -> DataFrame:
        places = records.select("source_id", "ordinal", F.posexplode(column).alias("nth", "v")).where("v <> ''")
        places = places.groupBy("source_id", "v").agg(F.min(F.struct("ordinal", "nth")).alias("at"))
        return places.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(column))

    ids = records.select("source_id").distinct()
    return ids.join(views, "source_id", "left").join(united("urls"), "source_id", "left").join(united("paths"), "source_id", "left")


def caption(line: Column) -> Column:
    """(kind, label, text) of a line that is a caption, else null."""
    kind = F.lower(F.regexp_extract(line, CAPTION, 1))
    made = F.struct(F.when(kind.startswith("f"), "figure").otherwise("table").alias("kind"), F.regexp_extract(line, CAPTION, 2).alias("label"), F.trim(F.regexp_extract(line, CAPTION, 3)).alias("text"))
    return F.when(kind != "", made)


def nearest_captions(items: DataFrame, captions: DataFrame) -> DataFrame:
    """(item_id, caption): for each table or figure the nearest caption above it on its page, else the nearest below.

    ``items`` has (item_id, source_file, page, top, bottom), ``captions`` (source_file, page, y, caption); y grows downwards.
    """
    # items and captions of a page in one order of places: the last caption met is the nearest, and no item meets all captions
    def nearest(edge: str, sign: int, name: str) -> DataFrame:
        place = lambda c: F.col(c) * F.lit(sign)
        told = captions.select("source_file", "page", place("y").alias("at"), F.lit(0).alias("kind"), "caption", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"))
        asked = items.select("source_file", "page", place(edge).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("caption"), "item_id")
        order = Window.partitionBy("source_file", "page").orderBy("at", "kind", F.desc("caption")).rowsBetween(Window.unboundedPreceding, 0)
        return told.unionByName(asked).withColumn(name, F.last("caption", ignorenulls=True).over(order)).where("kind = 1").select("item_id", name)

    above, below = nearest("top", 1, "_above"), nearest("bottom", -1, "_below")
    found = above.join(below, "item_id").select("item_id", F.coalesce("_above", "_below").alias("caption"))
    return found.where("caption is not null")


#: Lengths of a title in characters, and the fewest words it has.
TITLE_CHARS, TITLE_WORDS = (8, 220), 3
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def title_like(text: Column) -> Column:
    """Whether a line can be the title of a paper: of its length and three words at least, and none of the lines that stand beside titles.

    These are captions, numbered headings of usual sections, references in brackets, preprint stamps, dates (a month and a year),
    and sentences. Null is no title.
    """
    from attestor.operators.sections import HEADING_NAMES, OUTLINE, SECTION_WORDS

    flat = squeeze(text)
    tokens = F.filter(F.split(F.lower(flat), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    section = "|".join(words for _, words in SECTION_WORDS) + "|" + "|".join(HEADING_NAMES)
    dated = F.exists(tokens, lambda t: F.left(t, F.lit(3)).isin(*MONTHS) & (F.length(t) <= 9)) & F.exists(tokens, lambda t: t.rlike(r"^(?:19|20)\d\d$"))
    beside = {
        "caption": caption(flat).isNotNull() & flat.rlike(r"\d"),
        "section": flat.rlike(OUTLINE) & F.lower(flat).rlike(rf"^\S+\s+(?:{section})"),
        "reference": flat.startswith("["),
        "stamp": F.lower(flat).rlike(r"\barxiv\s*:"),
        "date": dated,
        "sentence": flat.endswith(".") & (F.size(tokens) > 2 * TITLE_WORDS),
    }
    plain = F.lit(True)
    for test in beside.values():
        plain = plain & ~F.coalesce(test, F.lit(False))
    return F.coalesce(F.length(flat).between(*TITLE_CHARS) & (F.size(F.split(flat, " ")) >= TITLE_WORDS) & plain, F.lit(False))


def document_titles(lines: DataFrame) -> DataFrame:
    """(source_file, title): the metadata title if it is one, else the title-like line of the largest font, the topmost of equals.

    ``lines`` has (source_file, metadata_title, text, font_size, top).
    """
    line = F.when(title_like(F.col("text")), squeeze(F.col("text")))
    rank = F.when(line.isNotNull(), F.struct((-F.col("font_size")).alias("size"), "top", "text"))
    found = lines.groupBy("source_file").agg(F.min_by(line, rank).alias("_line"), F.min("metadata_title").alias("_meta"))
    return found.select("source_file", F.coalesce(F.when(title_like(F.col("_meta")), squeeze(F.col("_meta"))), "_line").alias("title"))
