"""Evidence traces, cross-modal checks, contracts and triage: operators over parts that reach each of their branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.identity import date_only, fingerprint
from attestor.functions.text import file_name, markdown_cell
from attestor.functions.values import confidence
from attestor.operators import browse, catalog, charts, crossmodal, evidence, planning, quality, records, survey, triage, typing
from attestor.queries.audit import _metric_rows, _open_events
from attestor.queries.base import query, spread, table


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand").distinct()


def _traced(spark: SparkSession, d: str) -> DataFrame:
    """Traces of parts: brands are files, sizes pages; some brands have a source, some sources a file, some pages tables, figures or charts."""
    part = table(spark, d, "part")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("record_id"), F.concat("p_brand", F.lit(".pdf")).alias("source_file"), F.lit("pdf_text").alias("source_type"), F.col("p_size").cast("int").alias("page"),
        F.when(F.col("p_size") > 5, F.col("p_name")).alias("evidence_text"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("paper_title"),
    )
    files = _brands(spark, d).withColumn("source_file", F.concat("p_brand", F.lit(".pdf")))
    known = files.where("substr(p_brand, 7, 1) <> '5'")
    sources = known.select(F.col("p_brand").alias("source_id"), F.concat(F.lit("On "), "p_brand").alias("title"), F.array(F.concat(F.lit("dl/"), "source_file")).alias("paths"), F.col("p_brand").alias("ordinal"))
    artifacts = known.where("substr(p_brand, 8, 1) in ('1', '3')").select(F.col("p_brand").alias("source_id"), F.concat(F.lit("a-"), "p_brand").alias("artifact_id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("/x/"), F.upper("source_file")).alias("local_path"), F.lit(1).alias("ordinal"))
    halves = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, a, b in (("early", 1, 20), ("late", 21, 40)))))
    sections = files.select("source_file", halves.alias("h")).select("source_file", F.concat("source_file", F.lit(":"), "h.t").alias("section_id"), F.col("h.t").alias("section_title"), F.lit("").alias("text"), F.col("h.a").alias("page_start"), F.col("h.b").alias("page_end"), F.col("h.a").alias("ordinal"))
    pages = files.select("source_file", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("page")).withColumn("ordinal", F.col("page"))
    of = lambda name, every: pages.where(F.col("page") % every == 0).withColumn(name, F.concat_ws("-", F.lit(name[0]), "source_file", "page"))
    tables, figures = of("table_id", 7), of("figure_id", 5)
    read = figures.where("page % 10 = 0").select("figure_id", F.lit("axis reading").alias("extraction_method"))
    found = evidence.match_sources(rows, sources)
    met = rows.join(found.select("record_id", "source_id"), "record_id")
    return evidence.traces(
        rows, found, evidence.match_artifacts(met, artifacts), evidence.match_sections(rows, sections), evidence.match_on_page(rows, tables, "table_id").withColumn("table_method", F.lit("ruled lines")), evidence.match_on_page(rows, figures, "figure_id"), read
    )


_TRACE_SQL = """
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_brand, p_brand || '.pdf' AS f, p_size, p_size > 5 AS t, substr(p_brand, 7, 1) <> '5' AS s, p_size % 7 = 0 AS tab, p_size % 5 = 0 AS fig, p_size % 10 = 0 AS ch FROM part),
m AS (SELECT *, s AND substr(p_brand, 8, 1) IN ('1', '3') AS a, CASE WHEN p_size <= 20 THEN 'early' WHEN p_size <= 40 THEN 'late' END AS sec FROM r),
c AS (SELECT *, CAST(s AS INT) + CAST(a AS INT) + 1 + CAST(sec IS NOT NULL AS INT) + CAST(tab AS INT) + CAST(ch AND NOT tab AS INT) + CAST(t AS INT) AS n FROM m)
SELECT record_id, CASE WHEN s THEN p_brand END AS source_id, CASE WHEN a THEN 'a-' || p_brand END AS artifact_id, f || ':' || sec AS section_id, CASE WHEN tab THEN 't-' || f || '-' || p_size END AS table_id,
  CASE WHEN ch AND NOT tab THEN 'f-' || f || '-' || p_size END AS figure_id, CASE WHEN NOT (t OR tab OR fig) THEN 'unknown' WHEN tab THEN 'table' WHEN ch THEN 'figure' ELSE 'text' END AS evidence_type,
  CASE WHEN tab THEN 'ruled lines' WHEN ch THEN 'axis reading' WHEN t THEN 'text_extraction' END AS extraction_method, CASE WHEN n >= 4 THEN 'resolved' WHEN n > 1 THEN 'partial' ELSE 'unresolved' END AS locator_status,
  concat_ws(' | ', CASE WHEN NOT tab AND fig AND NOT ch THEN 'The page has a figure whose chart was not read.' END, CASE WHEN NOT s THEN 'No known source fits the record.' END, CASE WHEN NOT a THEN 'No file of the source fits the record.' END,
    CASE WHEN sec IS NULL THEN 'The page is known, its section is not.' END, CASE WHEN NOT t THEN 'There is no evidence text.' END) AS notes
FROM c"""


@query(_TRACE_SQL)
def evidence_traces(spark: SparkSession, d: str) -> DataFrame:
    """Where each record's source, file, section, table and figure are."""
    return _traced(spark, d).select("record_id", "source_id", "artifact_id", "section_id", "table_id", "figure_id", "evidence_type", "extraction_method", "locator_status", "notes")


@query(f"SELECT record_id, evidence_type FROM ({_TRACE_SQL}) WHERE locator_status = 'partial'")
def traces_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Traces of one locator status."""
    return browse.by_locator(_traced(spark, d), "partial").select("record_id", "evidence_type")


@query("""
WITH t AS (SELECT 'table' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_size <= 40 AS near, CASE WHEN p_size > 40 OR p_partkey % 2 = 1 THEN 0 ELSE 1 END AS matched, 2 AS candidates, true AS has FROM part),
g AS (SELECT 'figure', 'fig' || p_partkey, p_size < 30, CASE WHEN p_size < 30 AND p_size % 4 = 0 THEN 1 ELSE 0 END, 1, p_size % 2 = 0 FROM part WHERE p_size % 3 = 0),
a AS (SELECT * FROM t UNION ALL SELECT * FROM g),
s AS (SELECT *, CASE WHEN NOT has OR NOT near THEN 'not_comparable' WHEN matched > 0 THEN 'supported' ELSE 'partial' END AS status FROM a)
SELECT id AS subject_id, kind || CASE WHEN near THEN CASE kind WHEN 'table' THEN ',text' ELSE ',text,table' END ELSE '' END AS modalities, status, CAST(matched AS BIGINT) AS matched, CAST(candidates AS BIGINT) AS candidates,
  CASE WHEN NOT has THEN 'The figure shows no series of numbers.' WHEN NOT near AND kind = 'figure' THEN 'Neither text nor a table stands on the figure''s page.' WHEN NOT near THEN 'No text stands on the table''s page.'
       WHEN matched = 0 AND kind = 'figure' THEN 'No number near the chart is close to its values.' WHEN matched = 0 THEN 'No number in the text is close to the table''s values.' END AS issue,
  CASE status WHEN 'supported' THEN least(1.0, matched * 0.4 / candidates + 0.6) WHEN 'partial' THEN 0.35 ELSE 0.0 END AS confidence
FROM s
""")
def cross_modal_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of tables and figures, one of each part, against numbers on their page that are close, far or missing."""
    part = table(spark, d, "part").select("p_size", "p_retailprice", F.col("p_partkey").cast("string").alias("id"), F.lit("doc.pdf").alias("source_file"), F.col("p_partkey").cast("int").alias("page"), (F.col("p_partkey") % 2 == 1).alias("odd"))
    figures = part.where("p_size % 3 = 0")
    subjects = part.select(F.lit("table").alias("kind"), F.col("id").alias("subject_id"), "source_file", "page", F.lit(True).alias("contains_data")).unionByName(
        figures.select(F.lit("figure").alias("kind"), F.concat(F.lit("fig"), "id").alias("subject_id"), "source_file", "page", (F.col("p_size") % 2 == 0).alias("contains_data"))
    )
    size = F.col("p_size").cast("double")
    numbers = part.select(F.col("id").alias("subject_id"), F.explode(F.array("p_retailprice", size)).alias("value")).unionByName(figures.select(F.concat(F.lit("fig"), "id").alias("subject_id"), size.alias("value")))
    near = part.where("p_size <= 40").select(F.lit("table").alias("kind"), "source_file", "page", F.lit("text").alias("modality"))
    near = near.unionByName(figures.where("p_size < 30").select(F.lit("figure").alias("kind"), "source_file", "page", F.explode(F.array(F.lit("text"), F.lit("table"))).alias("modality")))
    told = part.where("p_size <= 40").select(F.lit("table").alias("kind"), "source_file", "page", (F.col("p_retailprice") * F.when(F.col("odd"), 2.0).otherwise(1.01)).alias("value"))
    told = told.unionByName(figures.where("p_size < 30").select(F.lit("figure").alias("kind"), "source_file", "page", (size + F.when(F.col("p_size") % 4 == 0, 0).otherwise(100)).alias("value")))
    found = crossmodal.checks(subjects, numbers, told, near)
    return found.select("subject_id", F.array_join("modalities", ",").alias("modalities"), "status", "matched", "candidates", "issue", "confidence")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    fields = F.create_map(
        F.lit("metric_name"), F.lit('"PCE"'), F.lit("metric_value"), F.concat(F.lit('"'), size, F.lit('%"')), F.lit("material"), F.concat(F.lit('"'), "p_name", F.lit('"')),
        F.lit("accuracy"), F.when(size % 2 == 0, (size / 100.0).cast("string")).otherwise('"n/a"'), F.lit("value"), F.lit('"n/a"'),
    )
    return spread(spark, d, "part", "p_partkey").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.col("p_partkey").alias("ordinal"), F.lit("metrics").alias("table_name"), fields.alias("fields"), F.lit("f.pdf").alias("source_file"), F.lit("pdf_text").alias("source_type"),
        F.lit(1).alias("page"), F.lit("e").alias("evidence_text"), F.lit(0.8).alias("confidence"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("paper_title"),
    )


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS derived_from, 'PCE' AS metric_name, CAST(p_size AS DOUBLE) AS metric_value, '%' AS unit, p_name AS material FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'accuracy', p_size / 100.0, NULL, p_name FROM part WHERE p_size % 2 = 0
""")
def strict_from_open_fields(spark: SparkSession, d: str) -> DataFrame:
    """Strict records from pairs of fields and from fields named like a metric; texts that are no number give none."""
    return records.strict_from_open(_payloads(spark, d)).select("derived_from", "metric_name", "metric_value", "unit", "material")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS record_id, '12' AS a, '["x"]' AS b, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '"maybe"' END AS c, '7' AS d, '"hot"' AS condition, '"5"' AS e, '[]' AS g,
  'odd' AS extra, CASE WHEN p_size % 5 = 0 THEN 'required field without a value: h' ELSE '' END AS warnings,
  CASE WHEN p_size % 3 = 0 THEN 'a:numeric_string_to_float,' ELSE '' END || 'b:scalar_to_list,' || CASE WHEN p_size % 2 = 0 THEN 'c:string_to_bool,' ELSE '' END || 'd:numeric_string_to_int,e:value_to_string,g:null_to_empty_list' AS events
FROM part
""")
def payload_contract(spark: SparkSession, d: str) -> DataFrame:
    """Payloads against a plan: declared types, a renamed context, what is extra, what is missing, and what was changed."""
    size = F.col("p_size")
    fields = F.create_map(
        F.lit("a"), F.when(size % 3 == 0, '"12"').otherwise("12"), F.lit("b"), F.lit('"x"'), F.lit("c"), F.when(size % 2 == 0, '"Yes"').otherwise('"maybe"'), F.lit("d"), F.lit('"+7"'), F.lit("setting"), F.lit('"hot"'),
        F.lit("e"), F.lit("5"), F.lit("g"), F.lit("null"), F.lit("h"), F.when(size % 5 == 0, '""').otherwise('"v"'), F.lit("odd"), F.lit("1"),
    )
    rows = spread(spark, d, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("record_id"), F.lit("t").alias("table_name"), fields.alias("fields"), F.array().cast("array<string>").alias("warnings"))
    kinds = {"a": "number", "b": "list[string]", "c": "boolean", "d": "integer", "condition": "string", "e": "string", "g": "list[string]", "h": "string", "url": "string", "page": "integer"}
    plan = spark.createDataFrame([("t", f, k, f in ("h", "url"), False, i) for i, (f, k) in enumerate(kinds.items())], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int")
    met = typing.conform(rows, typing.plan_contract(plan))
    event = lambda e: F.concat_ws(":", e["field"], e["event"])
    told = F.array_join(F.array_sort(F.transform("events", event)), ",")
    return met.select("record_id", *(F.element_at("fields", f).alias(f) for f in ("a", "b", "c", "d", "condition", "e", "g")), F.array_join(F.map_keys("extra"), ",").alias("extra"), F.array_join("warnings", ",").alias("warnings"), told.alias("events"))


_WORDS = "(['Papers', 'db', ' journal-article', 'GitHub', 'SI', 'odd One'])[p_size % 6 + 1]"


@query(f"SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'paper' WHEN 1 THEN 'open_database' WHEN 2 THEN 'paper' WHEN 3 THEN 'repository' WHEN 4 THEN 'supplementary_material' ELSE 'odd_one' END AS kind, {_WORDS} AS given FROM part")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Source types by their other spellings."""
    given = F.get(F.array(*map(F.lit, ["Papers", "db", " journal-article", "GitHub", "SI", "odd One"])), F.col("p_size") % 6)
    return table(spark, d, "part").select("p_partkey", typing.canonical("source_type", given).alias("kind"), given.alias("given"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 5 ELSE 3 END AS page, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS warned FROM part
""")
def page_of_block(spark: SparkSession, d: str) -> DataFrame:
    """A record's page is that of its block; one that differed is told."""
    other, blank = F.col("p_size") % 4 == 0, F.col("p_size") % 3 == 0
    page, block = F.when(other | ~blank, 3), F.when(other, 5).when(blank, 3)
    rows = table(spark, d, "part").select("p_partkey", page.alias("page"), block.alias("block_page"), F.array().cast("array<string>").alias("warnings"))
    return typing.fix_page(rows).select("p_partkey", "page", F.size("warnings").alias("warned"))


@query("""
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS record_id, json_extract_string(props, '$.k') IS NOT NULL AS k, event_type, value / 1000.0 < 0.6 AS low FROM events)
SELECT record_id, 'z' AS field, 'required field without a value: z' AS message FROM e
UNION ALL SELECT record_id, 'k', 'required field without a value: k' FROM e WHERE NOT k
UNION ALL SELECT record_id, 'confidence', 'Confidence is below the review threshold.' FROM e WHERE low
UNION ALL SELECT record_id, 'record_warning', event_type FROM e WHERE event_type <> ''
""")
def open_record_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of open records (events) against a plan that requires one field they have and one they lack."""
    plan = spark.createDataFrame([("paper_metadata", "k", True), ("paper_metadata", "z", True), ("paper_metadata", "first type", False)], "table_name string, field string, required boolean")
    return quality.check_open(_open_events(spark, d), plan).select("record_id", "field", "message")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_size % 2 = 0 THEN 'The evidence comes from a PDF, but its page is not known.' ELSE 'The recorded page does not hold the evidence.' END AS message FROM part
WHERE p_size > 5 AND (p_size % 2 = 0 OR p_partkey % 3 <> 0)
""")
def provenance_issue_rows(spark: SparkSession, d: str) -> DataFrame:
    """PDF records whose page is not known, or does not hold their evidence; pages are looked up by full and by base names."""
    rows = _metric_rows(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), "p_size"), "ordinal")
    key = F.col("ordinal")
    rows = rows.withColumns({"source_type": F.lit("pdf_text"), "page": F.when(F.col("p_size") % 2 == 1, key.cast("int")), "source_file": F.when(key % 2 == 0, "dir/A.pdf").otherwise("other/a.PDF")})
    text = F.when(key % 3 == 0, F.concat(F.lit("See: "), "evidence_text")).otherwise("empty page")
    pages = quality.page_texts(rows.select(F.lit("dir/a.pdf").alias("source_file"), key.cast("int").alias("page"), text.alias("text"), "ordinal").where("text is not null"))
    return quality.provenance_issues(quality.provenance(rows, pages)).select("record_id", "message")


_TRIAGE_ROWS = """SELECT CAST(p_partkey AS VARCHAR) AS source_id, (['arxiv', 'zenodo', 'github', 'crossref', 'other'])[p_size % 5 + 1] AS provider, p_partkey % 2 = 0 AS pdf, (['paper', 'dataset', 'repository'])[p_partkey % 3 + 1] AS kind,
  (['deep_read', 'metadata_only', 'read_readme', 'read_file_manifest', 'download_small_table', 'ask_user', 'reject', NULL])[p_size % 8 + 1] AS decision, p_retailprice / 3000.0 AS score FROM part"""


@query(f"""
WITH s AS ({_TRIAGE_ROWS}), i AS (SELECT *, provider IN ('arxiv', 'crossref') AS indexed FROM s)
SELECT source_id, CASE WHEN decision IS NULL OR decision = 'reject' THEN 'skip' WHEN decision = 'ask_user' THEN 'ask_user' WHEN decision = 'metadata_only' THEN CASE WHEN indexed THEN 'read_metadata' ELSE 'record_only' END
  WHEN decision = 'read_readme' THEN CASE WHEN provider = 'github' THEN 'read_readme' ELSE 'record_only' END WHEN decision IN ('read_file_manifest', 'download_small_table') THEN 'read_file_manifest'
  WHEN pdf AND provider = 'arxiv' THEN 'download_pdf' WHEN indexed THEN 'read_metadata' WHEN provider = 'github' THEN 'read_readme' WHEN kind = 'dataset' THEN 'read_file_manifest' ELSE 'record_only' END AS action,
  coalesce(decision = 'deep_read' AND pdf AND provider = 'arxiv', false) AS ingest, CASE WHEN decision IS NULL THEN 0.0 ELSE round(score, 4) END AS score,
  CASE WHEN decision = 'ask_user' THEN 'high' WHEN decision = 'deep_read' AND indexed AND NOT (pdf AND provider = 'arxiv') THEN 'medium' ELSE 'low' END AS risk FROM i
""")
def triage_of_selections(spark: SparkSession, d: str) -> DataFrame:
    """What comes of decisions on sources: carried out, brought down to what the source can, or skipped."""
    pick = lambda words, c: F.get(F.array(*map(F.lit, words)), c)
    part = table(spark, d, "part")
    sources = part.select(
        F.col("p_partkey").cast("string").alias("source_id"), F.col("p_partkey").alias("ordinal"), "p_size", F.col("p_name").alias("title"), F.lit("").alias("description"), F.lit("").alias("reason"), F.lit(0.5).alias("confidence"), pick(["arxiv", "zenodo", "github", "crossref", "other"], F.col("p_size") % 5).alias("provider"),
        F.when(F.col("p_partkey") % 2 == 0, "http://x/p.pdf").alias("pdf_url"), pick(["paper", "dataset", "repository"], (F.col("p_partkey") % 3).cast("int")).alias("source_type"), F.lit(None).cast("array<struct<name:string,type:string,size:bigint>>").alias("files"),
    )
    decided = ["deep_read", "metadata_only", "read_readme", "read_file_manifest", "download_small_table", "ask_user", "reject"]
    selections = part.where("p_size % 8 < 7").select(F.col("p_partkey").cast("string").alias("source_id"), pick(decided, F.col("p_size") % 8).alias("decision"), F.lit("medium").alias("priority"), (F.col("p_retailprice") / 3000.0).alias("priority_score"), F.lit("primary_paper").alias("source_role"), F.array().cast("array<string>").alias("risk_notes"))
    return triage.triage_selected(sources.drop("p_size"), selections).select("source_id", "action", "ingest", "score", "risk")


@query("""
WITH s AS (SELECT p_partkey, p_retailprice / 3000.0 AS score, p_size, p_size % 3 AS kind FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS n FROM s WHERE kind < 2)
SELECT CAST(s.p_partkey AS VARCHAR) AS source_id, CASE WHEN s.kind = 2 THEN 'read_metadata' WHEN n <= 40 THEN CASE s.kind WHEN 0 THEN 'download_pdf' ELSE 'read_readme' END WHEN s.kind = 0 THEN 'read_metadata' ELSE 'record_only' END AS action,
  s.kind = 0 AND coalesce(n <= 40, false) AS ingest, s.kind < 2 AND n > 40 AS deferred FROM s LEFT JOIN r USING (p_partkey)
""")
def resource_cap(spark: SparkSession, d: str) -> DataFrame:
    """Reads and downloads within a budget of forty (a cap is the feature), the others deferred to what is cheaper; none is lost."""
    kind = F.col("p_size") % 3
    rows = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("source_id"), F.col("p_partkey").alias("ordinal"), F.lit(0.5).alias("confidence"), F.when(kind == 1, "github").otherwise("arxiv").alias("provider"), F.lit("paper").alias("source_type"), F.lit("high").alias("priority"),
        (F.col("p_retailprice") / 3000.0).alias("score"), F.when(kind == 0, "download_pdf").when(kind == 1, "read_readme").otherwise("read_metadata").alias("action"), (kind == 0).alias("ingest"), F.lit("low").alias("risk"),
    )
    # equal scores: downloads would go before reads, so the key is a part of the score
    rows = rows.withColumn("score", F.struct("score", (-F.col("ordinal")).alias("first")))
    found = triage.cap_resources(rows, 40)
    return found.select("source_id", "action", "ingest", "deferred")


@query("""
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size % 2 = 0 THEN 1 END AS rank, CASE WHEN p_size <= 10 THEN CAST(p_size AS BIGINT) * 1048576 WHEN p_size % 2 = 0 THEN CAST(5242880 AS BIGINT) END AS bytes, (CAST(p_size AS BIGINT) + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 60 END) * 1048576 AS total FROM part
""")
def small_files(spark: SparkSession, d: str) -> DataFrame:
    """The file to take of each source: tables before documents, no larger than 10 MiB; and the size of all."""
    mb = lambda c: (c * 1048576).cast("bigint")
    file = lambda name, size: F.struct(F.lit(name).alias("name"), F.lit("").alias("type"), size.alias("size"))
    files = F.array(file("Data.CSV?x=1", mb(F.col("p_size").cast("bigint"))), file("about.pdf", mb(F.when(F.col("p_size") % 2 == 0, 5).otherwise(60).cast("bigint"))))
    best = triage.best_small_file(F.col("files"))
    return table(spark, d, "part").select("p_partkey", files.alias("files")).select("p_partkey", best["rank"].alias("rank"), best["bytes"].alias("bytes"), triage.total_size(F.col("files"), F.lit(None)).alias("total"))


@query("""
SELECT p_partkey, p_size % 3 <> 0 AS off, round(least(1.0, p_size / 100.0 + CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 0.0 END + least(0.2, p_partkey / 1000.0)), 4) AS score FROM part
""")
def topic_and_fallback_score(spark: SparkSession, d: str) -> DataFrame:
    """Whether a guarded topic of the question is missing, and the score of papers found elsewhere."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" Perovskite"))).otherwise(F.col("p_name"))
    score = triage.fallback_score(F.when(F.col("p_size") % 2 == 0, "paper").otherwise("dataset"), F.col("p_size") / 100.0, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", triage.off_topic("Stability of perovskite cells", text).alias("off"), score.alias("score"))


@query("""
SELECT o_orderkey AS figure_id, CAST(count(l_orderkey) + 1 AS INTEGER) AS points, 'log' AS x_scale, 'unknown' AS y_scale FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1
""")
def chart_repair_and_index(spark: SparkSession, d: str) -> DataFrame:
    """Charts (orders) without points that are no pair of finite numbers, with known scales, and their number of points."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    good = F.transform(F.sequence(F.lit(0), F.coalesce("n", F.lit(0))), lambda i: F.array(i.cast("double"), F.lit(1.0)))
    bad = F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(float("nan"))), F.array(F.lit(float("inf")), F.lit(1.0)), F.array(F.lit(1.0), F.lit(None).cast("double")))
    axis = lambda scale: F.struct(F.lit("nm").alias("unit"), F.lit(scale).alias("scale"), F.lit(0.0).alias("range_min"), F.lit(1.0).alias("range_max"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    made = rows.select(F.col("o_orderkey").alias("figure_id"), F.array(F.struct(F.lit("s").alias("name"), F.concat(bad, good).alias("points"))).alias("series"), axis("LOG").alias("x_axis"), axis("odd").alias("y_axis"))
    fixed = charts.repair(made)
    return fixed.join(charts.index(fixed), "figure_id").select("figure_id", F.col("point_count").alias("points"), F.col("x_axis.scale").alias("x_scale"), F.col("y_axis.scale").alias("y_scale"))


@query("""
SELECT p_partkey AS figure_id, CASE p_size % 4 WHEN 0 THEN 'accepted_second' WHEN 1 THEN 'manual_review' WHEN 2 THEN 'manual_review' ELSE 'kept_first' END AS decision, CASE WHEN p_size % 4 = 0 THEN 'second' ELSE 'first' END AS selected,
  CASE p_size % 4 WHEN 0 THEN false WHEN 3 THEN false ELSE true END AS needs_review FROM part
""")
def chart_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of each chart: the second is better, has lost its points, differs in a value, or is the same."""
    which = F.col("p_size") % 4
    axis = F.struct(F.lit("nm").alias("unit"), F.lit("linear").alias("scale"), F.lit(0.0).alias("range_min"), F.lit(20.0).alias("range_max"))
    series = lambda points: F.array(F.struct(F.lit("s").alias("name"), points.alias("points")))
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    far, near = F.array(point(F.lit(1), F.lit(2)), point(F.lit(500), F.lit(2))), F.array(point(F.lit(1), F.lit(2)), point(F.lit(5), F.lit(2)))
    other, none = F.array(point(F.lit(1), F.lit(2)), point(F.lit(9), F.lit(2))), F.array().cast("array<array<double>>")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("figure_id"), which.alias("w"), F.lit("line").alias("chart_type"), F.lit(True).alias("contains_data"), F.lit(0.9).alias("confidence"), axis.alias("x_axis"), axis.alias("y_axis"), F.lit("").alias("caption"))
    first = charts.validate(rows.withColumn("series", series(F.when(F.col("w") == 0, far).otherwise(near))))
    second = charts.validate(rows.withColumn("series", series(F.when(F.col("w") == 1, none).when(F.col("w") == 2, other).otherwise(near))))
    return charts.arbitrate(first, second)


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'By ' || p_brand ELSE 'own' END AS paper_title, CASE WHEN p_size % 3 = 0 THEN 'Ann; Bo' END AS authors FROM part
""")
def survey_with_sources(spark: SparkSession, d: str) -> DataFrame:
    """The survey's files with the paper that was downloaded under their base name, the last of several."""
    surveyed = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit(".pdf"))).otherwise("none.pdf").alias("source_file"), F.lit("own").alias("paper_title"))
    each = _brands(spark, d).select("p_brand", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    sources = each.select("ordinal", F.concat(F.lit("/dl/"), "p_brand", F.lit(".pdf")).alias("downloaded_path"), F.when(F.col("ordinal") == 2, F.concat(F.lit("By "), "p_brand")).otherwise("old").alias("title"), F.array(F.lit("Ann"), F.lit("Bo")).alias("authors"), F.lit("2024").alias("published"), F.lit("u").alias("url"))
    return survey.with_sources(surveyed, sources).select("p_partkey", "paper_title", "authors")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'Full of ' || p_brand WHEN 2 THEN 'Base of ' || p_brand END AS paper_title FROM part
""")
def title_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Empty titles by the full name of the file, else by its base name."""
    which = F.col("p_size") % 4
    rows = table(spark, d, "part").select("p_partkey", F.when(which == 1, F.concat(F.lit("in/"), "p_brand")).when(which == 2, F.concat(F.lit("elsewhere/b-"), "p_brand")).otherwise("unknown").alias("source_file"), F.when(which == 0, "kept").when(which == 1, "").alias("paper_title"))
    files = _brands(spark, d).select(F.explode(F.array(F.struct(F.concat(F.lit("in/"), "p_brand").alias("f"), F.concat(F.lit("Full of "), "p_brand").alias("t")), F.struct(F.concat(F.lit("at/b-"), "p_brand").alias("f"), F.concat(F.lit("Base of "), "p_brand").alias("t")))).alias("x"))
    return records.backfill_titles(rows, files.select(F.col("x.f").alias("source_file"), F.col("x.t").alias("title"))).select("p_partkey", "paper_title")


@query("""
WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3, p_retailprice DESC, CAST(p_partkey AS VARCHAR)) AS n FROM part WHERE p_partkey > 50)
SELECT CAST(p_partkey AS VARCHAR) AS source_id FROM part WHERE p_partkey <= 50 UNION ALL SELECT CAST(p_partkey AS VARCHAR) FROM h WHERE n <= 70 - (SELECT count(*) FROM part WHERE p_partkey <= 50)
""")
def history_fill(spark: SparkSession, d: str) -> DataFrame:
    """Current sources filled up to seventy from history, by fewest warnings and most confidence (a total is the feature)."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_id"), F.concat(F.lit("http://x/"), "p_partkey").alias("url"), (F.col("p_size") % 3).alias("warning_count"), F.col("p_retailprice").alias("confidence"), "p_partkey")
    return catalog.fill_from_history(part.where("p_partkey <= 50"), part, 70).select("source_id")


@query("""
SELECT p_partkey AS figure_id, CASE WHEN p_size % 2 = 0 THEN 'read' END AS chart, CASE WHEN p_size % 3 = 0 THEN 'supported' END AS status FROM part
""")
def figure_panel(spark: SparkSession, d: str) -> DataFrame:
    """Figures with their chart and their check, where there are any."""
    figures = table(spark, d, "part").select(F.col("p_partkey").alias("figure_id"), "p_size")
    found = browse.figure_panel(figures, figures.where("p_size % 2 = 0").select("figure_id", F.lit("read").alias("chart")), figures.where("p_size % 3 = 0").select(F.col("figure_id").alias("subject_id"), F.lit("supported").alias("status")))
    return found.select("figure_id", "chart", "status")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '10.1/x' WHEN p_size % 3 = 1 THEN '10.2/y' END AS doi, CASE WHEN p_size % 2 = 0 THEN '2024' ELSE '1999' END AS year, '["A"]' AS authors FROM part
""")
def source_row_view(spark: SparkSession, d: str) -> DataFrame:
    """Sources as flat rows: the first of synonymous metadata fields that has a value."""
    size = F.col("p_size")
    metadata = F.create_map(
        F.lit("doi"), F.when(size % 3 == 1, '"10.2/y"').otherwise("null"), F.lit("DOI"), F.when(size % 3 == 0, '""').otherwise('"10.1/x"'), F.lit("publication_year"), F.when(size % 2 == 0, "2024").otherwise("null"), F.lit("year"), F.lit("1999"),
        F.lit("authors"), F.lit("[]"), F.lit("creators"), F.lit('["A"]'),
    )
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"), F.lit("paper").alias("source_type"), F.lit("u").alias("url"), F.lit(0.5).alias("confidence"), metadata.alias("metadata"))
    return planning.source_rows(rows).select(F.col("source_id").alias("p_partkey"), "doi", "year", "authors")


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 WHEN p_size % 4 = 1 THEN 1.0 WHEN p_size % 4 = 2 THEN 0.5 ELSE 0.25 END AS confidence, CASE WHEN p_size % 2 = 0 THEN '2024-03-01' END AS day, regexp_replace(p_name || '/' || p_size, '[^A-Za-z0-9_.-]+', '_', 'g') AS file,
  replace(p_name, ' ', ' ') || ' \\| x' AS cell, sha256('{"a":' || p_size || ',"b":null}') AS digest FROM part
""")
def plain_values(spark: SparkSession, d: str) -> DataFrame:
    """Confidences, days, file names, Markdown cells and content fingerprints."""
    size = F.col("p_size")
    told = F.when(size % 4 == 0, "0").when(size % 4 == 1, "7").when(size % 4 == 2, "NaN").otherwise("0.25")
    day = date_only(F.when(size % 2 == 0, "2024-03-01T10:00:00Z").otherwise(""))
    return table(spark, d, "part").select(
        "p_partkey", confidence(told, 0.5).alias("confidence"), day.alias("day"), file_name(F.concat_ws("/", "p_name", "p_size")).alias("file"), markdown_cell(F.concat("p_name", F.lit("  | x"))).alias("cell"), fingerprint(size.alias("a"), F.lit(None).cast("string").alias("b")).alias("digest")
    )


@query("""
SELECT p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN 'near above' WHEN 1 THEN 'only below' END AS caption FROM part WHERE p_size % 3 < 2
""")
def caption_of_item(spark: SparkSession, d: str) -> DataFrame:
    """The nearest caption above each table or figure, else the nearest below."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_size", F.lit("f.pdf").alias("source_file"), F.col("p_partkey").alias("page"), F.lit(100.0).alias("top"), F.lit(200.0).alias("bottom"))
    caption = lambda y, text: F.struct(F.lit(y).alias("y"), F.lit(text).alias("caption"))
    above, below = F.array(caption(90.0, "near above"), caption(50.0, "far above"), caption(201.0, "below")), F.array(caption(150.0, "beside"), caption(220.0, "only below"), caption(300.0, "far below"))
    captions = items.where("p_size % 3 < 2").select("source_file", "page", F.explode(F.when(F.col("p_size") % 3 == 0, above).otherwise(below)).alias("c")).select("source_file", "page", "c.*")
    return planning.nearest_captions(items.drop("p_size"), captions)


@query("""
WITH p AS (SELECT 0 AS plan, 'arXiv' AS connector, p_type AS q, 'g' AS g, p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 1, 'ARXIV', upper(p_type), 'G', p_partkey FROM part)
SELECT arg_min(connector, (plan, q)) AS connector, arg_min(q, (plan, q)) AS query FROM p GROUP BY lower(connector), lower(q), lower(g)
""")
def merged_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of two plans, each once, the first plan's."""
    part = table(spark, d, "part")
    first = part.where("p_size % 2 = 0").select(F.lit("arXiv").alias("connector"), F.col("p_type").alias("query"), F.lit("g").alias("group_id"))
    second = part.select(F.lit("ARXIV").alias("connector"), F.upper("p_type").alias("query"), F.lit("G").alias("group_id"))
    return planning.merge_requests([first, second]).select("connector", "query")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'see report.pdf for it' ELSE 'see http://h.org/a/b/c.pdf' END AS note FROM part")
def public_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the public: local paths are gone, as columns and inside of texts; URLs stay."""
    from attestor.sources.guards import public_row

    note = F.when(F.col("p_size") % 2 == 0, "see /home/me/work/report.pdf for it").otherwise("see http://h.org/a/b/c.pdf")
    return public_row(table(spark, d, "part").select("p_partkey", note.alias("note"), F.lit("/x/y").alias("local_path")))


@query("""
WITH r AS (SELECT 'PCE' AS metric_name FROM (SELECT DISTINCT p_brand, p_name, p_size, p_type FROM part WHERE p_size > 10) UNION ALL SELECT 'PCE' FROM (SELECT DISTINCT lower(p_name), p_size FROM part) UNION ALL SELECT 'PCE' FROM part WHERE p_size % 3 = 1
  UNION ALL SELECT 'accuracy' FROM (SELECT DISTINCT lower(p_name), p_size FROM part WHERE p_size % 2 = 0) UNION ALL SELECT unnest(['accuracy', 'F1']) FROM part WHERE p_size % 3 = 0)
SELECT metric_name, count(*) AS n FROM r GROUP BY 1
""")
def engine_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of a whole run over texts, tables and open records, by metric: extracted, normalised, filtered, each once, checked and located."""
    from attestor.plans import engine
    from attestor.queries import extraction

    blocks = extraction.metric_sentences(spark, d).withColumn("source_file", F.concat(F.lit("f"), "ordinal"))
    opened = _payloads(spark, d).withColumn("origin", F.lit(None).cast("string"))
    plan = spark.createDataFrame([("metrics", "accuracy", "number", True, True, 1)], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int")
    return engine.run(blocks, extraction.part_tables(spark, d), opened, plan).records.groupBy("metric_name").agg(F.count("*").alias("n"))
