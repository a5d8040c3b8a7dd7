"""Records and their audit: normalising, de-duplicating, merging, curating, checking, conflicts, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import numbers
from attestor.functions.numbers import lenient_number, number_text, strict_number, value_in_text
from attestor.functions.text import norm_key
from attestor.operators import crossmodal, quality, records
from attestor.operators.common import first_per_key
from attestor.queries.base import query, spread, squeezed, table


@query("""
WITH c AS (SELECT l_partkey, l_returnflag, CAST(l_discount AS VARCHAR) AS v, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_returnflag, count(DISTINCT v) AS n_values, count(DISTINCT s) AS n_sources, CAST(sum(n) AS BIGINT) AS n_records,
       string_agg(DISTINCT v, ',' ORDER BY v) AS "values"
FROM c GROUP BY 1, 2 HAVING count(DISTINCT v) > 1
""")
def conflict_metric_groups(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ for one entity (part) and context (return flag); discounts are the values, suppliers the sources."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.col("l_discount").cast("string").alias("value"), F.col("l_suppkey").alias("source"))
    return quality.conflicts(rows, ["l_partkey", "l_returnflag"])


@query("""
WITH c AS (SELECT l_partkey, l_linestatus, CAST(l_tax AS VARCHAR) AS v, s_nationkey AS s, count(*) AS n
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT l_partkey, l_linestatus, count(DISTINCT v) AS n_values, count(DISTINCT s) AS n_sources, CAST(sum(n) AS BIGINT) AS n_records,
       string_agg(DISTINCT v, ',' ORDER BY v) AS "values"
FROM c GROUP BY 1, 2 HAVING count(DISTINCT v) > 1 AND count(DISTINCT s) > 1
""")
def conflict_cross_source(spark: SparkSession, d: str) -> DataFrame:
    """The same with at least two sources (nations of suppliers)."""
    met = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = met.select("l_partkey", "l_linestatus", F.col("l_tax").cast("string").alias("value"), F.col("s_nationkey").alias("source"))
    return quality.conflicts(rows, ["l_partkey", "l_linestatus"], 2)


@query("""
WITH o AS (SELECT lower(CAST(o_custkey AS VARCHAR)) AS cust, o_orderstatus AS st, o_orderpriority AS pr, CAST(o_orderdate AS DATE) AS dt, o_totalprice AS p FROM orders),
f AS (SELECT '[{"key":"condition_task","value":"' || pr || '"},{"key":"entity_id","value":"' || cust || '"}]' AS context, st, dt FROM o),
v AS (SELECT context, CASE WHEN st = 'O' THEN 'open' ELSE 'closed' END AS val, st AS src FROM f)
SELECT 'orders' AS table_name, context, 'result' AS field, count(DISTINCT val) AS n_values, count(DISTINCT src) AS n_sources, count(*) AS n_records,
       string_agg(DISTINCT val, ',' ORDER BY val) AS "values"
FROM v GROUP BY context HAVING count(DISTINCT val) > 1 AND count(DISTINCT src) > 1
""")
def conflict_open_records(spark: SparkSession, d: str) -> DataFrame:
    """Open records (orders) whose result differs between sources (statuses) for one customer and priority."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = F.create_map(
        F.lit("entity_id"), quoted(F.col("o_custkey").cast("string")), F.lit("TaskCondition"), quoted(F.col("o_orderpriority")),
        F.lit("result"), F.when(F.col("o_orderstatus") == "O", '"open"').otherwise('"closed"'), F.lit("page"), F.lit("3"),
    )
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.lit("orders").alias("table_name"), fields.alias("fields"), F.col("o_orderstatus").alias("source_file"))
    return quality.open_conflicts(rows)


@query(f"""
SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY lower({squeezed("text")})
""")
def record_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text but for case and white space: the first and its number of copies."""
    # the digest takes the place of the text before the shuffle
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2(norm_key(F.col("text")), 256).alias("digest"))
    return first_per_key(rows, ["digest"], [F.col("doc_id")], "copies").select("doc_id", "source", "copies")


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag, round(l_discount, 8), l_linestatus ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS n,
                  count(*) OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag, round(l_discount, 8), l_linestatus) AS merged FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount, merged FROM k WHERE n = 1
""")
def strict_record_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Strict records (line items) of equal file, material, method, metric, value and condition: the first."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", F.concat(F.lit("Supplier-"), "l_suppkey").alias("source_file"), F.concat(F.lit("Part  "), "l_partkey").alias("material"), F.col("l_returnflag").alias("method"),
        F.lit("discount").alias("metric_name"), F.col("l_discount").alias("metric_value"), F.lit(None).cast("string").alias("unit"), F.col("l_linestatus").alias("condition"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("ordinal"),
    )
    return records.deduplicate(rows, "merged").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "merged")


def _open_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as open records: the user is the file, the properties are fields, the type is a warning."""
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("first type"), F.concat(F.lit('"'), "event_type", F.lit('"'))))
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("record_id"), F.col("event_id").alias("ordinal"), F.lit("paper_metadata").alias("table_name"), fields.alias("fields"), F.concat(F.lit("user "), "user_id").alias("source_file"),
        F.lit("csv").alias("source_type"), F.lit(None).cast("int").alias("page"), F.col("event_type").alias("evidence_text"), (F.col("value") / 1000.0).alias("confidence"), F.array("event_type").alias("warnings"),
        F.lit(None).cast("string").alias("paper_title"), F.lit(None).cast("string").alias("origin"),
    )


@query("""
WITH t AS (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2),
w AS (SELECT user_id, string_agg(event_type, '|' ORDER BY pos) AS warnings FROM t GROUP BY 1)
SELECT 'user ' || e.user_id AS source_file, CAST(min(e.event_id) AS VARCHAR) AS record_id, max(e.value / 1000.0) AS confidence, count(*) AS merged,
       arg_min(json_extract_string(props, '$.k'), event_id) AS k, arg_min(event_type, event_id) AS first_type, any_value(w.warnings) AS warnings
FROM events e JOIN w USING (user_id) GROUP BY 1
""")
def record_merge_fold(spark: SparkSession, d: str) -> DataFrame:
    """Open records of one file merged into one: first values, most confidence, warnings in order of appearance."""
    found = records.merge_open(_open_events(spark, d))
    return found.select(
        "source_file", "record_id", "confidence", "merged", F.element_at("fields", "k").alias("k"), F.replace(F.element_at("fields", "first type"), F.lit('"')).alias("first_type"), F.array_join("warnings", "|").alias("warnings")
    )


@query("""
SELECT CAST(event_id AS VARCHAR) AS record_id, 'paper_metadata' AS table_name, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
UNION ALL SELECT CAST(event_id AS VARCHAR), 'paper_metadata', 'first type', event_type FROM events
""")
def dynamic_field_explode(spark: SparkSession, d: str) -> DataFrame:
    """Every field of open records (event properties) as a row."""
    return records.explode_fields(_open_events(spark, d))


@query("""
SELECT CAST(event_id AS VARCHAR) AS record_id, json_extract_string(props, '$.k') AS k, event_type AS "first type", CAST(NULL AS VARCHAR) AS unplanned FROM events
""")
def dynamic_wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One planned table of open records, with a column that no record has."""
    return records.wide_table(_open_events(spark, d), "paper_metadata", ["k", "first type", "unplanned"])


@query("""
SELECT CAST(event_id AS VARCHAR) AS record_id,
  concat_ws(' | ', 'date or authors of the paper are missing; a catalogue''s metadata is better',
    'extraction gave warnings',
    CASE WHEN value / 1000.0 < 0.6 THEN 'confidence below the review threshold' END) AS reasons
FROM events
""")
def curation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why open records (events) need review."""
    return records.curate(_open_events(spark, d)).select("record_id", F.array_join("reasons", " | ").alias("reasons"))


@query("""
WITH r AS (SELECT doc_id, n_chars, coalesce(lang = 'fr', false) AS warned, doc_id % 3 = 0 AS deployment, lower(CASE WHEN n_chars % 2 = 0 THEN 'Parameters of ' ELSE 'Size in MB of ' END || coalesce(left(text, 20), '')) AS evidence FROM documents),
t AS (SELECT *, CASE WHEN warned THEN 'framework,model_size_mb' WHEN deployment AND contains(evidence, 'parameters') AND NOT contains(evidence, 'mb') THEN 'model_size_mb' ELSE '' END AS taken FROM r)
SELECT doc_id, taken, CASE WHEN taken = '' THEN CAST(n_chars AS VARCHAR) ELSE 'null' END AS size, CASE WHEN warned THEN 'null' ELSE '"x"' END AS framework FROM t
""")
def curation_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Values that curation takes out of records of documents: all where a warning says so (French ones), a model size that was read off a parameter count elsewhere."""
    evidence = F.concat(F.when(F.col("n_chars") % 2 == 0, "Parameters of ").otherwise("Size in MB of "), F.coalesce(F.left("text", F.lit(20)), F.lit("")))
    warned = F.coalesce(F.col("lang") == "fr", F.lit(False))
    rows = table(spark, d, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("record_id"), F.when(F.col("doc_id") % 3 == 0, "deployment_efficiency").otherwise("results").alias("table_name"),
        F.create_map(F.lit("model_size_mb"), F.col("n_chars").cast("string"), F.lit("framework"), F.lit('"x"'), F.lit("empty"), F.lit("null")).alias("fields"), evidence.alias("evidence_text"),
        F.when(warned, F.array(F.lit("This value SHOULD be null."))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.lit(0.9).alias("confidence"), F.lit("model").alias("origin"), F.lit("csv").alias("source_type"), F.lit(1).alias("page"),
    )
    made = records.curate(rows)
    return made.select("doc_id", F.array_join(F.array_sort(F.map_keys("repaired")), ",").alias("taken"), F.col("fields")["model_size_mb"].alias("size"), F.col("fields")["framework"].alias("framework"))


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Strict records made of parts: name by size, the type as unit, the price as value, none for the large ones."""
    names = ["Accuracy", " pce", "RMSE", "user study", "Inference Time", "colour", "number of  parameters", "f1-score", "yield", "Model Size"]
    name = F.get(F.array(*map(F.lit, names)), F.col("p_size") % len(names))
    units = ["percent", "", "HOURS", "nm", "℃"]
    unit = F.get(F.array(*map(F.lit, units)), F.col("p_size") % len(units))
    shown = F.concat(F.col("p_name"), F.lit(" costs "), F.when(F.col("p_size") > 25, number_text(F.col("p_retailprice"))).otherwise("a lot"))
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.col("p_partkey").alias("ordinal"), name.alias("metric_name"), F.when(F.col("p_size") <= 45, F.col("p_retailprice")).alias("metric_value"), unit.alias("unit"),
        F.col("p_brand").alias("source_file"), F.lit("csv").alias("source_type"), F.lit(None).cast("int").alias("page"), F.when(F.col("p_size") > 5, shown).alias("evidence_text"), F.lit(0.72).alias("confidence"),
        F.array().cast("array<string>").alias("warnings"), F.col("p_type").alias("material"), F.lit(None).cast("string").alias("paper_title"), F.col("p_name").alias("method"), F.lit(None).cast("string").alias("condition"),
    )


_NAME_SQL = """(['Accuracy', ' pce', 'RMSE', 'user study', 'Inference Time', 'colour', 'number of  parameters', 'f1-score', 'yield', 'Model Size'])[p_size % 10 + 1]"""
_UNIT_SQL = """(['percent', '', 'HOURS', 'nm', '℃'])[p_size % 5 + 1]"""
_CANON_SQL = f"""CASE lower(trim(regexp_replace({_NAME_SQL}, ' +', ' ', 'g'))) WHEN 'accuracy' THEN 'accuracy' WHEN 'pce' THEN 'PCE' WHEN 'rmse' THEN 'RMSE' WHEN 'number of parameters' THEN 'number of parameters'
  WHEN 'f1-score' THEN 'F1' ELSE trim({_NAME_SQL}) END"""
_CANON_UNIT_SQL = f"""CASE lower({_UNIT_SQL}) WHEN 'percent' THEN '%' WHEN 'hours' THEN 'h' WHEN '℃' THEN 'degC' WHEN '' THEN CASE WHEN {_CANON_SQL} IN ('accuracy', 'F1', 'number of parameters') THEN 'dimensionless' ELSE '' END
  ELSE {_UNIT_SQL} END"""


@query(f"""
SELECT p_partkey, {_CANON_SQL} AS metric, {_CANON_UNIT_SQL} AS unit,
  p_size <= 45 AND ({_CANON_SQL} IN ('accuracy', 'PCE', 'RMSE', 'F1', 'number of parameters') OR regexp_matches(lower({_CANON_SQL}), 'time|size|rate|parameter|accuracy|mse')) AS strict
FROM part
""")
def metric_normalise_and_filter(spark: SparkSession, d: str) -> DataFrame:
    """Canonical metric and unit names, and which records are numeric metrics."""
    rows = records.mark_strict(records.normalise(_metric_rows(spark, d)))
    return rows.select(F.col("ordinal").alias("p_partkey"), F.col("metric_name").alias("metric"), "unit", "strict")


@query(f"""
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS record_id, {_CANON_SQL} AS metric, {_CANON_UNIT_SQL} AS unit, p_size, p_retailprice,
                  CASE WHEN p_size <= 5 THEN 0.45 WHEN p_size > 45 THEN 0.55 WHEN p_size <= 25 THEN 0.5 ELSE 0.72 END AS confidence FROM part),
i AS (
  SELECT record_id, 'warning' AS level, 'evidence_text' AS field FROM r WHERE p_size <= 5
  UNION ALL SELECT record_id, 'warning', 'metric_value' FROM r WHERE p_size > 45
  UNION ALL SELECT record_id, 'warning', 'evidence_text' FROM r WHERE p_size BETWEEN 6 AND 25
  UNION ALL SELECT record_id, 'info', 'unit' FROM r WHERE unit = '' AND metric NOT IN ('accuracy', 'F1', 'number of parameters')
  UNION ALL SELECT record_id, 'warning', 'confidence' FROM r WHERE confidence < 0.6)
SELECT * FROM i
""")
def record_check_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of strict records: evidence, value, unit and confidence."""
    checked = quality.check_strict(records.normalise(_metric_rows(spark, d)))
    return quality.issue_rows(checked).select("record_id", "level", "field")


@query(f"""
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_partkey, {_CANON_SQL} AS metric, {_CANON_UNIT_SQL} AS unit, p_size, p_type, p_name, p_retailprice, p_size % 3 = 0 AND p_size > 5 AS checked, p_partkey % 2 = 0 AS shown,
                  CASE WHEN p_size <= 5 THEN 0.45 WHEN p_size > 45 THEN 0.55 WHEN p_size <= 25 THEN 0.5 ELSE 0.72 END AS confidence FROM part),
i AS (
  SELECT record_id, 'warning' AS level FROM r WHERE p_size <= 5
  UNION ALL SELECT record_id, 'warning' FROM r WHERE p_size > 45
  UNION ALL SELECT record_id, 'warning' FROM r WHERE p_size BETWEEN 6 AND 25
  UNION ALL SELECT record_id, 'info' FROM r WHERE unit = '' AND metric NOT IN ('accuracy', 'F1', 'number of parameters')
  UNION ALL SELECT record_id, 'warning' FROM r WHERE confidence < 0.6
  UNION ALL SELECT record_id, 'warning' FROM r WHERE checked AND NOT shown),
c AS (SELECT count(*) AS n FROM (SELECT 1 FROM r WHERE p_size <= 45 GROUP BY lower(p_type), lower(metric), lower(p_name) HAVING count(DISTINCT (p_retailprice, unit)) > 1)),
t AS (SELECT count(*) AS n, count(*) FILTER (p_size > 5) AS e, count(*) FILTER (p_size BETWEEN 26 AND 45) AS v, count(*) FILTER (checked) AS asked, count(*) FILTER (checked AND shown) AS located FROM r),
o AS (SELECT count(*) AS n, count(*) FILTER (event_type <> '') AS e FROM events),
b AS (SELECT count(*) AS n, count(*) FILTER (level = 'warning') AS w, count(*) FILTER (level = 'error') AS bad, count(DISTINCT record_id) FILTER (level <> 'info') AS records FROM i)
SELECT t.n AS record_count, o.n AS dynamic_record_count, t.n + o.n AS total_record_count, b.n + c.n AS issue_count, b.w + c.n AS warning_count, b.bad AS error_count, c.n AS conflict_count,
  round(t.e / t.n, 4) AS evidence_coverage, round((t.e + o.e) / (t.n + o.n), 4) AS evidence_text_coverage, round(t.v / t.n, 4) AS value_evidence_coverage, round(t.located / t.asked, 4) AS provenance_page_coverage,
  round((t.n + o.n - b.records) / (t.n + o.n), 4) AS warning_free_rate, b.records AS review_count, (SELECT count(DISTINCT p_brand) FROM part) AS source_count
FROM t, o, b, c
""")
def quality_report_row(spark: SparkSession, d: str) -> DataFrame:
    """The quality report: strict records made of parts, some from PDF pages that show them or not, open records made of events, and all conflicts."""
    pdf = F.col("ordinal")  # each record has a page of its own
    rows = _metric_rows(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), "p_size"), "ordinal")
    rows = rows.withColumns({"source_type": F.when(F.col("p_size") % 3 == 0, "pdf_text").otherwise("csv"), "page": pdf.cast("int")}).drop("p_size")
    pages = quality.page_texts(rows.select("source_file", "page", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("All of it: "), "evidence_text", F.lit("."))).otherwise("Nothing of the kind.").alias("text"), "ordinal").where("text is not null"))
    checked = quality.check_strict(records.normalise(rows))
    located = quality.provenance(checked, pages)
    issues = quality.issue_rows(checked).unionByName(quality.provenance_issues(located))
    return quality.report(located, _open_events(spark, d), issues, located, quality.metric_conflicts(located))


@query("""
SELECT 'warning' AS level, count(*) AS n FROM labels WHERE quality = 0 HAVING count(*) > 0
UNION ALL SELECT 'error', count(*) FROM labels WHERE toxic = 1 HAVING count(*) > 0
""")
def issue_severity_recount(spark: SparkSession, d: str) -> DataFrame:
    """How many issues there are of each level, over the union of two issue tables (labels of low quality, toxic labels)."""
    labels = table(spark, d, "labels")
    return quality.severity_counts(labels.where("quality = 0").select(F.lit("warning").alias("level")), labels.where("toxic = 1").select(F.lit("error").alias("level")))


@query("""
WITH d AS (SELECT * FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)),
c AS (SELECT count(*) AS total, count(*) FILTER (text <> '') AS a, count(*) FILTER (lang <> '') AS b, count(*) FILTER (source <> '') AS c, count(quality) AS q FROM d)
SELECT field, CAST(present AS BIGINT) AS present, total, round(present / total, 4) AS coverage FROM (
  SELECT 'text' AS field, a AS present, total FROM c UNION ALL SELECT 'lang', b, total FROM c UNION ALL SELECT 'source', c, total FROM c UNION ALL SELECT 'quality', q, total FROM c)
""")
def field_coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The share of documents that have each field; the quality comes from the labels."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    tests = {c: F.coalesce(F.col(c) != "", F.lit(False)) for c in ("text", "lang", "source")} | {"quality": F.col("quality").isNotNull()}
    return quality.field_coverage(docs, tests)


_SQUASH = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"


@query(f"""
WITH p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS page FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, c.turn, length({_SQUASH.format("c.text")}) >= 8 AND coalesce(contains({_SQUASH.format("page")}, {_SQUASH.format("c.text")}), false) AS contained
FROM conversations c LEFT JOIN p USING (conv_id) WHERE c.text <> ''
""")
def provenance_containment(spark: SparkSession, d: str) -> DataFrame:
    """Whether each turn is found on the page that all answers of its conversation make, as one stretch of letters and digits."""
    from attestor.functions.text import squash

    turns = table(spark, d, "conversations")
    pages = quality.page_texts(turns.where("role = 'assistant'").select(F.lit("conversations").alias("source_file"), F.col("conv_id").alias("page"), "text", F.col("turn").alias("ordinal")))
    met = turns.where("text <> ''").join(pages.select(F.col("page").alias("conv_id"), F.col("text").alias("page_text")), "conv_id", "left")
    evidence = squash(F.col("text"))
    return met.select("conv_id", "turn", ((F.length(evidence) >= quality.LEAST_EVIDENCE) & F.contains(squash(F.col("page_text")), evidence)).alias("contained"))


_TOKENS = r"regexp_extract_all(lower({}), '\d+(?:\.\d+)*|[a-z]+[a-z0-9]*(?:-[a-z0-9]+)*|[㐀-鿿]+')"


@query(f"""
WITH p AS (SELECT conv_id, string_agg({_SQUASH.format("text")}, '' ORDER BY turn) AS flat, string_agg(list_aggregate(list_transform({_TOKENS.format("text")}, lambda t: ' ' || t || ' '), 'string_agg', ''), '' ORDER BY turn) AS words FROM conversations WHERE role = 'assistant' GROUP BY 1),
r AS (SELECT conv_id, turn, coalesce(trim(text), '') <> '' AS checked, {_SQUASH.format("coalesce(text, '')")} AS flat, {_TOKENS.format("coalesce(text, '')")} AS tokens FROM conversations),
j AS (SELECT r.*, checked AND length(r.flat) >= 8 AND (coalesce(contains(p.flat, r.flat), false) OR (len(tokens) >= 4 AND (len(tokens) >= 8 OR len(list_filter(tokens, lambda t: regexp_matches(t, '^[0-9]'))) > 0)
  AND coalesce(words LIKE '%' || list_aggregate(list_transform(tokens, lambda t: ' ' || t || ' '), 'string_agg', '%') || '%', false))) AS located FROM r LEFT JOIN p USING (conv_id))
SELECT conv_id || ':' || turn AS record_id, checked, located, CAST(CASE WHEN checked AND NOT located THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence FROM j
""")
def provenance_on_page(spark: SparkSession, d: str) -> DataFrame:
    """The full test, with tokens in order where the stretch is not found."""
    turns = table(spark, d, "conversations")
    pages = quality.page_parts(turns.where("role = 'assistant'").select(F.lit("conversations").alias("source_file"), F.col("conv_id").alias("page"), "text", F.col("turn").alias("ordinal")))
    rows = turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("record_id"), F.lit("Conversations").alias("source_file"), F.lit("pdf_text").alias("source_type"), F.col("conv_id").alias("page"), F.col("text").alias("evidence_text"),
        F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("warnings"),
    )
    return quality.provenance(rows, pages).select("record_id", "checked", "located", "confidence")


@query("""
SELECT conv_id, count(*) AS parts, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1
""")
def page_text_build(spark: SparkSession, d: str) -> DataFrame:
    """All texts of a page (conversation) in order, as one."""
    turns = table(spark, d, "conversations")
    pages = quality.page_texts(turns.select(F.lit("conv").alias("source_file"), F.col("conv_id").alias("page"), "text", F.col("turn").alias("ordinal")))
    parts = turns.groupBy("conv_id").agg(F.count("*").alias("parts"))
    return pages.join(parts, pages.page == parts.conv_id).select("conv_id", "parts", F.md5("text").alias("digest"))


@query(r"""
WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS v, regexp_replace(lower(coalesce(text, '')), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000},%]+', '', 'g') AS flat FROM documents)
SELECT doc_id, coalesce(regexp_matches(flat, '(^|[^0-9.])(' || CAST(CAST(v AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(v AS BIGINT) AS VARCHAR) || '[.]0|' || CAST(CAST(v AS BIGINT) AS VARCHAR) || '[.]00)($|[^0-9.]|[.]$|[.][^0-9])'), false) AS shown FROM d
""")
def value_in_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's text shows its own number of characters."""
    return table(spark, d, "documents").select("doc_id", value_in_text(F.col("n_chars").cast("double"), F.col("text")).alias("shown"))


_FORMS = """[p_brand, CAST(p_size AS VARCHAR) || ' %', CAST(p_size AS VARCHAR) || ' x ' || CAST(p_size AS VARCHAR), CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 1 AS VARCHAR), 'N/A', p_name, '1,' || CAST(p_size + 100 AS VARCHAR), 'about ' || CAST(p_size AS VARCHAR) || ' or ' || CAST(p_size AS VARCHAR)]"""


@query(rf"""
WITH f AS (SELECT p_partkey, unnest({_FORMS}) AS t, generate_subscripts({_FORMS}, 1) - 1 AS form FROM part),
x AS (SELECT *, lower(trim(t)) AS p, replace(lower(trim(t)), ',', '') AS q FROM f),
y AS (SELECT *, TRY_CAST(trim(regexp_replace(q, '%$', '')) AS DOUBLE) AS whole, regexp_extract_all(q, '[-+]?\d*\.?\d+(?:e[-+]?\d+)?') AS nums FROM x)
SELECT p_partkey, CAST(form AS INTEGER) AS form,
 CASE WHEN p IN ('', 'null', 'none', 'n/a', 'na', 'nan', '-', 'unknown', 'not reported') THEN NULL WHEN whole IS NOT NULL THEN whole WHEN regexp_matches(p, '\d\s*[x×*]\s*\d') THEN NULL WHEN regexp_matches(p, '\d\s*[-~–]\s*\d') THEN NULL WHEN len(nums) = 1 THEN CAST(nums[1] AS DOUBLE) END AS value,
 CASE WHEN p IN ('', 'null', 'none', 'n/a', 'na', 'nan', '-', 'unknown', 'not reported') THEN '{numbers.BLANK}' WHEN whole IS NOT NULL THEN '{numbers.READ}' WHEN regexp_matches(p, '\d\s*[x×*]\s*\d') THEN '{numbers.SIZE}'
   WHEN regexp_matches(p, '\d\s*[-~–]\s*\d') THEN '{numbers.SPAN}' WHEN len(nums) = 1 THEN '{numbers.MIXED}' WHEN len(nums) > 1 THEN '{numbers.SEVERAL}' ELSE '{numbers.WORDS}' END AS warning
FROM y
""")
def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from texts of many forms, made of parts: plain, percent, sizes, ranges, words, thousands, several."""
    size = F.col("p_size").cast("string")
    forms = F.array(
        "p_brand", F.concat(size, F.lit(" %")), F.concat(size, F.lit(" x "), size), F.concat(size, F.lit("-"), (F.col("p_size") + 1).cast("string")), F.lit("N/A"), "p_name",
        F.concat(F.lit("1,"), (F.col("p_size") + 100).cast("string")), F.concat(F.lit("about "), size, F.lit(" or "), size),
    )
    rows = spread(spark, d, "part", "p_partkey").select("p_partkey", F.posexplode(forms).alias("form", "t")).withColumn("n", lenient_number(F.col("t")))
    return rows.select("p_partkey", "form", "n.value", "n.warning")


@query("""
SELECT p_partkey, p_retailprice AS value, CAST(NULL AS DOUBLE) AS other FROM part
""")
def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are a number and nothing else, with percent and thousands commas, and texts that are more."""
    price = F.concat(F.lit(" "), F.format_number("p_retailprice", 2), F.lit(" % "))
    return table(spark, d, "part").select("p_partkey", strict_number(price).alias("value"), strict_number(F.concat(price, F.lit("x"))).alias("other"))


@query("""
WITH v AS (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS v FROM lineitem)
SELECT l_partkey, l_suppkey, count(*) AS candidates, CAST(count(*) FILTER (abs(v - p_retailprice) <= greatest(0.02, abs(v) * 0.03)) AS BIGINT) AS matched
FROM v JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def cross_modal_band_match(spark: SparkSession, d: str) -> DataFrame:
    """How many unit prices of a part at a supplier are close to its retail price: numbers on one page within a band."""
    values = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    references = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("value"))
    return crossmodal.band_matches(values, references, ["l_partkey"]).select("l_partkey", F.col("id").alias("l_suppkey"), "candidates", "matched")


