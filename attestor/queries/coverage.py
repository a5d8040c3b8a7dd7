"""Coverage of a plan, gaps, stop decision, review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.labels import evidence_kind, label_tokens
from attestor.operators import coverage, review
from attestor.operators.coverage import match_labels
from attestor.queries.base import query, table

#: (table, field, type, required, evidence_required): what line items, grouped by return flag, are planned to tell.
PLAN = [
    ("A", "discount values", "number", True, True),
    ("A", "tax rate", "number", False, True),
    ("N", "ship date", "string", True, True),
    ("N", "discount values", "number", True, True),
    ("R", "benchmark dataset", "string", True, True),
    ("R", "page", "number", True, True),
    ("R", "figure plots", "string", False, False),
]


def _plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, i) for i, row in enumerate(PLAN)], "table_name string, field string, type string, required boolean, evidence_required boolean, ordinal int")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Line items as open records: the return flag is the table, small discounts and taxes are missing, dates are only in some tables."""
    maybe = lambda test, value: F.when(test, value.cast("string")).otherwise("null")
    fields = F.create_map(
        F.lit("DiscountValue"), maybe(F.col("l_discount") > 0.02, F.col("l_discount")), F.lit("tax"), maybe(F.col("l_tax") > 0.03, F.col("l_tax")),
        F.lit("ship_date"), F.when(F.col("l_returnflag") == "N", '"x"').otherwise('""'),
    )
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("table_name"), fields.alias("fields"))


_ITEMS = """
i AS (
  SELECT 'discount values' AS name, 'high' AS priority, count(*) FILTER (l_discount > 0.02 AND l_returnflag IN ('A', 'N')) AS present, count(*) FILTER (l_returnflag IN ('A', 'N')) AS total, count(*) FILTER (l_discount > 0.02) AS mentions FROM lineitem
  UNION ALL SELECT 'tax rate', 'low', count(*) FILTER (l_tax > 0.03 AND l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_tax > 0.03) FROM lineitem
  UNION ALL SELECT 'ship date', 'high', count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'N') FROM lineitem
  UNION ALL SELECT 'benchmark dataset', 'high', 0, count(*) FILTER (l_returnflag = 'R'), 0 FROM lineitem
  UNION ALL SELECT 'page', 'high', 0, count(*) FILTER (l_returnflag = 'R'), 0 FROM lineitem),
c AS (SELECT *, present / total AS coverage FROM i),
r AS (SELECT name, priority, CASE WHEN coverage >= 0.75 THEN 'covered' WHEN coverage > 0 OR mentions > 0 THEN 'partial' WHEN name = 'benchmark dataset' THEN 'unavailable' ELSE 'missing' END AS status, coverage, mentions,
  CASE priority WHEN 'high' THEN 3.0 ELSE 1.0 END AS weight FROM c)
"""


def _gone(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("dataset",)], "evidence string")


@query(f"WITH {_ITEMS} SELECT name, priority, status, round(coverage, 6) AS coverage, CAST(mentions AS BIGINT) AS mentions FROM r")
def coverage_requirements(spark: SparkSession, d: str) -> DataFrame:
    """How far each planned field is covered by the records of the tables that declare it; names match by their words."""
    return coverage.requirement_coverage(_plan(spark), _records(spark, d), _gone(spark)).select("name", "priority", "status", F.round("coverage", 6).alias("coverage"), "mentions")


@query(f"WITH {_ITEMS} SELECT round(sum(weight * least(1.0, coverage)) / sum(weight), 6) AS coverage_score FROM r")
def coverage_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """The weighted mean of the coverages."""
    items = coverage.requirement_coverage(_plan(spark), _records(spark, d), _gone(spark))
    return coverage.weighted_score(items).select(F.round("coverage_score", 6).alias("coverage_score"))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as artifacts: the priority tells the kind, the status the state, the price the relevance."""
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "pdf").when(p == "2-HIGH", "csv").when(p == "3-MEDIUM", "image").otherwise("readme")
    status = F.when(p == "3-MEDIUM", "failed").when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "inspected").otherwise("planned")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("artifact_id"), kind.alias("artifact_type"), status.alias("status"), F.when(F.col("o_custkey") > 500, "x").alias("local_path"), F.when(F.col("o_custkey") > 200, "http://x").alias("url"), (F.col("o_totalprice") / 100000.0).alias("relevance_score")
    )


@query("""
WITH a AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN ['paper_full_text'] WHEN '2-HIGH' THEN ['table', 'dataset'] WHEN '3-MEDIUM' THEN ['figure'] ELSE ['code_repository'] END AS e,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'parsed' WHEN o_orderstatus = 'O' THEN 'inspected' ELSE 'planned' END AS s FROM orders), x AS (SELECT unnest(e) AS evidence, s FROM a)
SELECT evidence, bool_or(s = 'parsed') AS covered, bool_and(s IN ('failed', 'skipped')) AS unavailable FROM x GROUP BY 1
""")
def evidence_availability(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of evidence are covered by a parsed artifact, and which can't be had any more."""
    return coverage.evidence_availability(_artifacts(spark, d))


@query("""
SELECT o_orderkey AS artifact_id FROM orders WHERE o_totalprice / 100000.0 >= 3.0 AND o_custkey > 500 AND o_orderpriority <> '3-MEDIUM' AND o_orderstatus <> 'F'
""")
def unprocessed_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of high relevance that wait to be worked through, downloads not allowed."""
    return coverage.unprocessed(_artifacts(spark, d), downloads=False).select("artifact_id")


@query(f"""
WITH {_ITEMS}
SELECT 'requirement_' || replace(name, ' ', '_') || '_' || left(sha1(name), 8) AS gap_id, 'requirement' AS kind, priority, status FROM r WHERE status <> 'covered'
UNION ALL SELECT 'evidence_figure_' || left(sha1('figure'), 8), 'evidence', 'high', 'unavailable'
UNION ALL SELECT 'unprocessed_relevant_artifacts', 'artifacts', 'high', 'missing' WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice / 100000.0 >= 3.0 AND o_custkey > 200 AND o_orderpriority <> '3-MEDIUM' AND o_orderstatus = 'O')
   OR EXISTS (SELECT 1 FROM orders WHERE o_totalprice / 100000.0 >= 3.0 AND o_orderpriority <> '3-MEDIUM' AND o_orderstatus = 'P')
""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Open requirements, kinds of evidence that are required and not covered, and waiting artifacts."""
    return _gaps(spark, d).select("gap_id", "kind", "priority", "status")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    items = coverage.requirement_coverage(_plan(spark), _records(spark, d), _gone(spark))
    wanted = coverage.required_evidence(spark.createDataFrame([("Figures and plots",), ("Paper text",), ("nothing in particular",)], "requirement string"))
    return coverage.gaps(items, wanted, coverage.evidence_availability(_artifacts(spark, d)), coverage.unprocessed(_artifacts(spark, d)))


@query(f"""
WITH {_ITEMS}, s AS (SELECT l_returnflag AS t, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1),
g AS (SELECT 'a' AS group_id, 'A' AS table_name, 2 AS fields, count(*) FILTER (status IN ('missing', 'partial')) AS missing_fields, bool_or(status IN ('missing', 'partial') AND name = 'discount values') AS req, sum(weight * coverage) / sum(weight) AS score FROM r WHERE name IN ('discount values', 'tax rate')
  UNION ALL SELECT 'n', 'N', 1, count(*) FILTER (status IN ('missing', 'partial')), bool_or(status IN ('missing', 'partial')), sum(weight * coverage) / sum(weight) FROM r WHERE name = 'ship date'
  UNION ALL SELECT 'r', 'R', 1, count(*) FILTER (status IN ('missing', 'partial')), bool_or(status IN ('missing', 'partial')), sum(weight * coverage) / sum(weight) FROM r WHERE name = 'benchmark dataset')
SELECT group_id, CAST(fields AS BIGINT) AS fields, missing_fields, req AS required_missing, round(score, 6) AS coverage_score, n AS n_sources,
  CASE WHEN group_id = 'r' THEN 'pending' WHEN score >= 0.6 AND n >= 3 AND NOT req THEN 'sufficient' WHEN group_id = 'a' THEN 'exhausted' ELSE 'insufficient' END AS status
FROM g JOIN s ON t = table_name
""")
def group_coverage_status(spark: SparkSession, d: str) -> DataFrame:
    """The state of each planned table: its weighted coverage, its sources, and what is left of its search."""
    return _groups(spark, d).select("group_id", "fields", "missing_fields", "required_missing", F.round("coverage_score", 6).alias("coverage_score"), "n_sources", "status")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    items = coverage.requirement_coverage(_plan(spark), _records(spark, d), _gone(spark))
    sources = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("table_name")).agg(F.count_distinct("l_suppkey").alias("n_sources"))
    searched = spark.createDataFrame([("a", True, 2), ("n", True, 0)], "group_id string, initial boolean, retries int")
    return coverage.group_coverage(_plan(spark), items, sources, searched)


@query("SELECT 'r' AS group_id, 'pending' AS status")
def weakest_group(spark: SparkSession, d: str) -> DataFrame:
    """The group to search next."""
    return coverage.weakest_group(_groups(spark, d)).select("group_id", "status")


@query("SELECT 'continue' AS decision")
def stop_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether work may stop: a gap of high priority blocks it."""
    return coverage.stop_decision(_gaps(spark, d), _groups(spark, d))


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, list_distinct(list_transform(string_split(name, ' '), lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END)) AS k FROM n),
w AS (SELECT DISTINCT p_type || ' widgets' AS label FROM part), l AS (SELECT label, [lower(split_part(label, ' ', 1)), 'widget'] AS k FROM w)
SELECT label, name FROM l, t WHERE len(list_intersect(l.k, t.k)) = least(len(l.k), len(t.k)) OR len(list_filter(list_intersect(l.k, t.k), lambda x: length(x) >= 6)) > 0
""")
def fuzzy_label_match(spark: SparkSession, d: str) -> DataFrame:
    """Labels and names that mean the same by their words: part types, put as labels, and part names."""
    part = table(spark, d, "part")
    labels = part.select(F.concat("p_type", F.lit(" widgets")).alias("label")).distinct()
    names = part.select(F.col("p_name").alias("name")).distinct()
    return match_labels(labels, "label", names, "name")


@query("""
SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(lower(regexp_replace(p_brand || 'ColdThings ' || p_name || 'es', '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'),
  lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 4 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END))), 'string_agg', ' ') AS tokens,
  CASE WHEN p_type = 'PROMO' THEN 'figure' WHEN p_type = 'SMALL' THEN 'dataset' WHEN p_type = 'LARGE' THEN 'code_repository' END AS evidence
FROM part
""".replace("\\\\", "\\"))
def label_token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Token sets of labels in the singular, and the kind of evidence that a label asks for."""
    label = F.concat("p_brand", F.lit("ColdThings "), "p_name", F.lit("es"))
    asked = F.when(F.col("p_type") == "PROMO", "bar charts").when(F.col("p_type") == "SMALL", "Databases used").when(F.col("p_type") == "LARGE", "sourceCode").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(label_tokens(label), " ").alias("tokens"), evidence_kind(asked).alias("evidence"))


@query(f"""
SELECT 'review_' || left(sha1('record|' || doc_id || '|record_quality'), 12) AS review_id, 'record' AS subject_type, CAST(doc_id AS VARCHAR) AS subject_id, CASE WHEN toxic = 1 THEN 'high' ELSE 'medium' END AS priority, CASE WHEN toxic = 1 THEN 'toxic' ELSE '{review.FLAGGED}' END AS reason FROM (SELECT DISTINCT * FROM labels) WHERE quality = 0
UNION ALL SELECT 'review_' || left(sha1('conflict|' || event_type || '|source_conflict'), 12), 'conflict', event_type, 'high', 'Sources disagree.' FROM (SELECT DISTINCT event_type FROM events)
""")
def review_queue_order(spark: SparkSession, d: str) -> DataFrame:
    """The review queue: labels of low quality are flagged records, event types are conflicts."""
    labels = table(spark, d, "labels").where("quality = 0").distinct()
    records = labels.select(F.col("doc_id").alias("record_id"), F.when(F.col("toxic") == 1, 0.2).otherwise(0.7).alias("confidence"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.lit(" toxic "))).otherwise(F.array(F.lit(" "))).alias("warnings"))
    conflicts = table(spark, d, "events").select(F.col("event_type").alias("conflict_id"), F.lit("").alias("message")).distinct()
    none = lambda schema: spark.createDataFrame([], schema)
    queued = review.queue(records, none("figure_id string, errors int, needs_review boolean, reason string"), none("check_id string, status string, issue string"), conflicts, none("gap_id string, priority string, name string"))
    return review.ordered(queued).select("review_id", "subject_type", "subject_id", "priority", "reason")


@query("""
WITH d AS (SELECT doc_id, (CASE WHEN toxic = 1 THEN 4 ELSE 0 END) + (CASE WHEN coalesce(text, '') = '' THEN 3 ELSE 0 END) + 2 + (CASE WHEN n_chars / 1000.0 < 0.75 THEN 2 ELSE 0 END) + (CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS risk
  FROM documents LEFT JOIN (SELECT DISTINCT * FROM labels) USING (doc_id))
SELECT doc_id, risk FROM d ORDER BY risk DESC, doc_id LIMIT 100
""")
def validation_sample(spark: SparkSession, d: str) -> DataFrame:
    """The hundred documents of highest risk (a sample of fixed size is the feature)."""
    met = table(spark, d, "documents").join(table(spark, d, "labels").distinct(), "doc_id", "left")
    rows = met.select(
        "doc_id", F.col("doc_id").alias("ordinal"), F.when(F.col("toxic") == 1, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.col("text").alias("evidence_text"), F.lit(None).cast("int").alias("page"),
        F.lit("pdf_text").alias("source_type"), (F.col("n_chars") / 1000.0).alias("confidence"), F.col("quality").alias("metric_value"),
    )
    return review.validation_sample(rows, 100).select("doc_id", "risk")
