"""Reading results: search, pages, frequencies, surveys, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.evidence import match_sources
from attestor.operators import browse, survey
from attestor.queries.base import query, table


@query("""
SELECT doc_id, lang, source FROM documents WHERE contains(lower('{"doc_id":' || coalesce(CAST(doc_id AS VARCHAR), '') || coalesce(',"lang":"' || lang || '"', '') || coalesce(',"source":"' || source || '"', '') || '}'), 'src1')
""")
def record_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose JSON holds a text in any case."""
    return browse.search(table(spark, d, "documents"), "SRC1", ["doc_id", "lang", "source"]).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def page_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    """The third page of parts by price (a page is the feature)."""
    return browse.page(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), 3, [F.desc("p_retailprice"), "p_partkey"])


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred events (a tail is the feature)."""
    return browse.tail(table(spark, d, "events"), 100, ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT o_orderkey AS task_id, o_orderdate AS updated_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The hundred tasks (orders) of one status that were changed last (a list of fixed length is the feature)."""
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderstatus").alias("status"))
    return browse.newest(tasks, 100, "F").select("task_id", "updated_at")


@query("""
WITH r AS (SELECT * FROM events ORDER BY event_id LIMIT 100) SELECT field, count(*) AS n FROM (SELECT event_type AS field FROM r UNION ALL SELECT 'k' FROM r WHERE json_extract_string(props, '$.k') IS NOT NULL) GROUP BY 1 ORDER BY n DESC, field LIMIT 4
""")
def field_frequency_topn(spark: SparkSession, d: str) -> DataFrame:
    """The four most frequent fields of the first hundred records (both numbers are the feature)."""
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.col("event_type"), F.lit("1")))
    return browse.top_fields(table(spark, d, "events").select(F.col("event_id").alias("ordinal"), fields.alias("fields")), 4)


@query("""
SELECT doc_id AS source_id FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) WHERE lang <> 'fr' AND (quality IS NULL OR quality >= 0.45)
""")
def relevant_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are not skipped (French ones are) and score enough or not at all."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("source_id"), F.when(F.col("lang") == "fr", "skip").otherwise("read").alias("action"), F.col("quality").cast("double").alias("score"))
    return browse.relevant(rows).select("source_id")


@query("SELECT event_id AS id FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, value DESC, event_type, event_id LIMIT 40")
def observed_sources_topk(spark: SparkSession, d: str) -> DataFrame:
    """The forty rows to look at first: failed ones, then by relevance (a top-k is the feature)."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"), F.col("value").alias("relevance_score"))
    return browse.top_observed(rows, 40).select("id")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'nation_' || c_nationkey END AS title, CASE WHEN c_acctbal > 0 THEN 'nation_' || c_nationkey ELSE 'other' END AS stem, CASE WHEN c_acctbal > 0 THEN 'nation_' || c_nationkey || '.pdf' ELSE 'other' END AS name FROM customer),
s AS (SELECT n_nationkey, lower(n_name) AS title, 'http://x/' || n_nationkey || '/nation_' || n_regionkey || '.pdf?x' AS url FROM nation)
SELECT n_nationkey AS source_id, c_custkey AS record_id FROM s JOIN r ON r.title = s.title OR contains(s.title, stem) OR contains(stem, s.title) OR contains(url, name)
""")
def records_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Records (customers) of each source (nation): by titles and stems that hold one another, and by URLs that hold file names."""
    sources = table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("title"), F.concat(F.lit("http://X/"), "n_nationkey", F.lit("/Nation_"), "n_regionkey", F.lit(".pdf?x")).alias("url"))
    name = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    records = table(spark, d, "customer").select(
        F.col("c_custkey").alias("record_id"), F.when(F.col("c_acctbal") > 5000, name).alias("paper_title"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("a/"), name, F.lit(".pdf"))).otherwise("other").alias("source_file")
    )
    return browse.records_of_sources(sources, records)


@query("""
WITH s AS (SELECT p_partkey, lower(p_name || ' by ' || p_brand || ' report ' || p_partkey || '.pdf') AS title FROM part),
r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'report ' || c_custkey WHEN 1 THEN 'brand#' || (c_custkey % 40) WHEN 2 THEN 't ' || c_custkey || '.pdf' WHEN 3 THEN substr(lower(c_name), 1, 1) ELSE lower(c_name) END AS name FROM customer),
k AS (SELECT name, min(p_partkey) AS p FROM (SELECT DISTINCT name FROM r) JOIN s ON contains(title, name) GROUP BY name)
SELECT c_custkey AS record_id, p AS source_id, 3 AS tier FROM r JOIN k USING (name)
""")
def sources_with_names(spark: SparkSession, d: str) -> DataFrame:
    """The first source (part) whose title holds a record's (customer's) file name: numbers, brands, parts of words, single letters, and names that none has."""
    title = F.concat("p_name", F.lit(" by "), "p_brand", F.lit(" report "), "p_partkey", F.lit(".pdf"))
    sources = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), title.alias("title"), F.array().cast("array<string>").alias("paths"), F.col("p_partkey").alias("ordinal"))
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("Report "), key)).when(key % 5 == 1, F.concat(F.lit("Brand#"), key % 40)).when(key % 5 == 2, F.concat(F.lit("t "), key, F.lit(".pdf"))).when(key % 5 == 3, F.left("c_name", F.lit(1))).otherwise(F.col("c_name"))
    records = table(spark, d, "customer").select(key.alias("record_id"), F.lit(None).cast("string").alias("paper_title"), F.concat(F.lit("in/"), name).alias("source_file"))
    return match_sources(records, sources).select("record_id", "source_id", "tier")


@query("""
WITH m AS (SELECT source, lang, min(doc_id) AS pos FROM documents WHERE lang <> '' GROUP BY 1, 2), l AS (SELECT source, string_agg(lang, '; ' ORDER BY pos) AS materials FROM m GROUP BY 1)
SELECT source AS source_file, count(*) AS record_count, count(CASE WHEN n_chars > 500 THEN 1 END) AS numeric_record_count, any_value(materials) AS datasets_or_materials FROM documents LEFT JOIN l USING (source) GROUP BY 1
""")
def paper_survey_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row a file (source of documents): counts, and the languages in order of appearance."""
    rows = table(spark, d, "documents").select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("ordinal"), F.lit(None).cast("string").alias("paper_title"), F.col("lang").alias("material"), F.lit("").alias("method"), F.lit("m").alias("metric_name"), F.lit(1).alias("page"),
        F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("metric_value"), F.lit("").alias("evidence_text"),
    )
    return survey.survey(rows).select("source_file", "record_count", "numeric_record_count", "datasets_or_materials")


@query("""
SELECT (SELECT count(*) FROM documents) AS documents_count, (SELECT count(*) FROM events) AS events_count, (SELECT count(*) FROM labels) AS labels_count
""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run."""
    return survey.run_summary(**{n: table(spark, d, n) for n in ("documents", "events", "labels")})


@query("SELECT unnest(['parsed_but_no_records']) AS code")
def workflow_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts that the counters of a run raise: here documents were parsed and gave no record."""
    counts = survey.run_summary(blocks=table(spark, d, "documents"), sources=table(spark, d, "pages"), ingested=table(spark, d, "pages"))
    return survey.alerts(counts.withColumns({"records_count": F.lit(0), "review_count": F.lit(0)}))


@query("""
SELECT field, coverage FROM (SELECT 'lang' AS field, round(count(lang) / count(*), 4) AS coverage FROM documents UNION ALL SELECT 'long', round(count(*) FILTER (n_chars > 500) / count(*), 4) FROM documents)
""")
def least_covered_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields by coverage, the least first."""
    from attestor.operators.quality import field_coverage

    docs = table(spark, d, "documents")
    return browse.least_covered(field_coverage(docs, {"lang": F.col("lang").isNotNull(), "long": F.col("n_chars") > 500})).select("field", "coverage")
