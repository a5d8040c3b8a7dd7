"""Sources: identity, clusters, the catalogue and its upkeep, evidence lookups, triage, guards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.identity import doi, identity_keys, source_url, stable_id
from attestor.functions.labels import relevance, topic_tokens
from attestor.operators import catalog, clustering, evidence, triage
from attestor.operators.clustering import shared_base
from attestor.queries.base import query, table
from attestor.sources import commit, guards
from attestor.streaming import upsert


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, nullif(CASE WHEN auth = '' THEN regexp_replace(lower(trim(url)), '/+$', '') ELSE regexp_replace(lower(auth), '^www\.', '') || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/+$', '') END, '') AS url FROM p
""")
def doc_url_normalise(spark: SparkSession, d: str) -> DataFrame:
    """URLs of pages in the form in which they are compared."""
    return table(spark, d, "pages").select("page_id", source_url(F.col("url")).alias("url"))


@query(r"""
SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https?://(?:dx\.)?doi\.org/', ''), '^doi:\s*', ''), '[.,;:)\]}]+$', ''), '') AS doi
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'https://doi.org/10.' || doc_id || '/AB.' WHEN lang = 'de' THEN ' doi: 10.' || doc_id || ').' WHEN lang = 'fr' THEN 'HTTP://dx.doi.org/10.' || source ELSE '' END AS raw FROM documents)
""")
def doi_normalise(spark: SparkSession, d: str) -> DataFrame:
    """DOIs in several spellings, made of documents."""
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit("https://doi.org/10."), "doc_id", F.lit("/AB.")))
        .when(F.col("lang") == "de", F.concat(F.lit(" doi: 10."), "doc_id", F.lit(").")))
        .when(F.col("lang") == "fr", F.concat(F.lit("HTTP://dx.doi.org/10."), "source"))
        .otherwise("")
    )
    return table(spark, d, "documents").select("doc_id", doi(raw).alias("doi"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS title FROM pages)
SELECT page_id, concat_ws(' ', 'record:web:' || page_id, 'url:' || regexp_replace(lower(auth), '^www\.', '') || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/+$', ''), CASE WHEN title <> '' AND NOT starts_with(title, 'untitled ') THEN 'title:' || title END) AS keys FROM p
""")
def identity_key_lists(spark: SparkSession, d: str) -> DataFrame:
    """All keys that a page can be recognised by: its record, its URL and its title."""
    null = F.lit(None).cast("string")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    keys = identity_keys(F.col("page_id").cast("string"), title, F.col("url"), null, null, F.col("page_id").cast("string"), F.lit("Web"), null, null, null, F.lit(None).cast("int"))
    return table(spark, d, "pages").select("page_id", F.array_join(keys, " ").alias("keys"))


@query("""
SELECT doc_id, 'evidence_' || left(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(lang, ''), coalesce(source, ''))), 12) AS id FROM documents
""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are the same at each run."""
    return table(spark, d, "documents").select("doc_id", stable_id("evidence", F.col("doc_id"), F.col("lang"), F.col("source")).alias("id"))


def _keyed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as provider records: keys are the digests of the whole text and of its first line."""
    keys = F.array(F.concat(F.lit("text:"), F.md5("text")), F.concat(F.lit("line:"), F.md5(F.substring_index("text", "\n", 1))))
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), keys.alias("keys"), F.col("doc_id").alias("ordinal"), F.col("source").alias("provider"), (F.col("n_chars") / 100000.0).alias("confidence"), "lang")


@query("""
WITH k AS (SELECT doc_id, 't' || md5(text) AS k FROM documents UNION ALL SELECT doc_id, 'l' || md5(split_part(text, chr(10), 1)) FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS lo FROM k)
SELECT doc_id, min(lo) AS root FROM g GROUP BY 1
""")
def source_cluster_components(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of documents that share their text or their first line; equal texts share it, so SQL needs no recursion."""
    found = clustering.components(_keyed_documents(spark, d))
    return found.select(F.col("id").alias("doc_id"), "root")


@query()
def source_cluster_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as records come one by one. An ordered fold, which SQL does not have; a test replays it."""
    rows = _keyed_documents(spark, d)
    return clustering.greedy_clusters(rows, clustering.components(rows))


@query("""
WITH l AS (SELECT split_part(text, chr(10), 1) AS k, * FROM documents), p AS (SELECT k, source, min(doc_id) AS pos FROM l WHERE source <> '' GROUP BY 1, 2),
g AS (SELECT k, string_agg(source, '|' ORDER BY pos) AS providers FROM p GROUP BY 1)
SELECT min(doc_id) AS source_id, count(*) AS n_records, any_value(providers) AS providers, max(n_chars / 100000.0) AS confidence, arg_min(lang, doc_id) FILTER (lang IS NOT NULL) AS lang FROM l LEFT JOIN g USING (k) GROUP BY k
""")
def source_cluster_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of documents merged: providers in order, most confidence, the first language."""
    rows = _keyed_documents(spark, d)
    rows = rows.withColumn("metadata", F.create_map(F.lit("lang"), F.coalesce(F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("null"))))
    merged = clustering.merge_clusters(rows, clustering.components(rows).withColumnRenamed("root", "cluster"))
    return merged.select("source_id", "n_records", F.array_join("providers", "|").alias("providers"), "confidence", F.replace(F.element_at("metadata", "lang"), F.lit('"')).alias("lang"))


@query("""
WITH l AS (SELECT split_part(text, chr(10), 1) AS k, lower(source) AS source, doc_id FROM documents WHERE source <> '')
SELECT (SELECT min(doc_id) FROM documents e WHERE split_part(e.text, chr(10), 1) = l.k) AS cluster, 'origin' AS field, count(DISTINCT source) AS n_values, arg_min(source, doc_id) AS kept FROM l GROUP BY k HAVING count(DISTINCT source) > 1
""")
def source_value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose documents differ in a field (their source)."""
    rows = _keyed_documents(spark, d).withColumn("metadata", F.create_map(F.lit("origin"), F.coalesce(F.concat(F.lit('"'), "provider", F.lit('"')), F.lit("null"))))
    return clustering.value_conflicts(rows, clustering.components(rows).withColumnRenamed("root", "cluster"))


@query("""
SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) ON o_orderkey = l_orderkey
""")
def catalog_flatten_outer(spark: SparkSession, d: str) -> DataFrame:
    """One row for each artifact (line) of a source (order); sources without any keep one row."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.struct("l_linenumber", "l_quantity")).alias("artifacts"))
    entries = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    return catalog.flatten(entries)


@query("""
SELECT o_orderkey, o_orderpriority AS selection_action, CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS triage_action, coalesce(CASE WHEN o_totalprice > 200000 THEN o_totalprice END, CAST(o_custkey AS DOUBLE)) AS relevance_score FROM orders
""")
def catalog_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Left lookups of what was decided about each source; orders stand for sources, the dear ones are triaged."""
    orders = table(spark, d, "orders").withColumn("source_id", F.col("o_orderkey"))
    selections = orders.select("source_id", F.col("o_orderpriority").alias("decision"), F.col("o_custkey").cast("double").alias("priority_score"))
    triaged = orders.where("o_totalprice > 200000").select("source_id", F.col("o_orderstatus").alias("action"), F.col("o_totalprice").alias("score"))
    sources = orders.select("source_id", F.lit(0.0).alias("confidence"))
    return catalog.with_decisions(sources, selections, triaged).select(F.col("source_id").alias("o_orderkey"), "selection_action", "triage_action", "relevance_score")


@query("""
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
""")
def status_histograms(spark: SparkSession, d: str) -> DataFrame:
    """How often each status and each priority occurs, in one pass."""
    return catalog.histograms(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'inspected' ELSE 'parsed' END AS s FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN bool_or(s = 'parsed') THEN 'parsed' ELSE 'inspected' END AS s FROM p GROUP BY 1, 2),
c AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'planned' WHEN 'A' THEN 'downloaded' ELSE 'failed' END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, t AS was, CASE WHEN s = 'parsed' THEN s WHEN t IN ('planned', 'failed') THEN s ELSE t END AS status FROM c JOIN b USING (l_orderkey, l_linenumber)
""")
def catalog_state_merge(spark: SparkSession, d: str) -> DataFrame:
    """Current artifacts (lines, state by return flag) with an earlier state (by line status): the more advanced holds."""
    li = table(spark, d, "lineitem")
    base = [
        F.col("l_orderkey").cast("string").alias("source_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("local_path"), F.lit("line").alias("artifact_type"), F.col("l_linenumber").cast("string").alias("name"),
        F.array().cast("array<string>").alias("completed_operations"),
    ]
    current = li.select(*base, "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "planned").when(F.col("l_returnflag") == "A", "downloaded").otherwise("failed").alias("status")).distinct()
    prior = li.select(*base, F.when(F.col("l_linestatus") == "O", "inspected").otherwise("parsed").alias("status"))
    merged = catalog.merge_state(current.withColumn("was", F.col("status")), prior)
    return merged.select("l_orderkey", "l_linenumber", "was", "status")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 15 THEN 'planned' WHEN l_quantity < 40 THEN 'downloaded' ELSE 'inspected' END AS status FROM lineitem),
r AS (SELECT *, CASE status WHEN 'planned' THEN 1 WHEN 'inspected' THEN 2 ELSE 3 END AS n FROM e)
SELECT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(l_linenumber AS VARCHAR) AS name, arg_max(status, n) AS status, array_to_string(list_sort(list(DISTINCT status)), ',') AS done, 3 AS batch, false AS replayed FROM r GROUP BY 1, 2
""")
def artifacts_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts (order lines) whose states arrive in four batches of a stream and are merged into one table; the third is sent again and changes nothing."""
    quantity = F.col("l_quantity")
    status = F.when(quantity < 15, "planned").when(quantity < 40, "downloaded").otherwise("inspected")
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("source_id"), none("url"), none("local_path"), F.lit("line").alias("artifact_type"), F.col("l_linenumber").cast("string").alias("name"), status.alias("status"), F.array(status).alias("completed_operations"),
        (F.col("l_partkey") % 4).alias("batch"),
    )
    folder = f"{shared_base(spark).rstrip('/')}/attestor-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    batch = lambda i: rows.where(F.col("batch") == i).drop("batch")
    for i in range(4):
        batch(i).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{folder}/in")
        upsert.upserts(arriving, f"{folder}/state", catalog.upsert_state, f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    again = upsert.apply(f"{folder}/state", batch(2), 2, catalog.upsert_state)
    number = commit.current(spark, f"{folder}/state")["batch"]
    return upsert.state(spark, f"{folder}/state").select("source_id", "name", "status", F.array_join(F.array_sort("completed_operations"), ",").alias("done"), F.lit(number).alias("batch"), F.lit(again).alias("replayed"))


@query("""
SELECT doc_id, source AS provider FROM documents WHERE n_chars > 1000 AND lang = 'en' AND source = (SELECT min(source) FROM documents WHERE source <> '')
UNION ALL SELECT doc_id, 'any' FROM documents WHERE n_chars > 1000 AND lang = 'en'
""")
def ingestible_sources(spark: SparkSession, d: str) -> DataFrame:
    """Long documents in English are chosen for download: those of the first provider (source), and those of any."""
    docs = table(spark, d, "documents")
    first = docs.where("source <> ''").agg(F.min("source")).first()[0]
    decisions = docs.select("doc_id", F.col("source").alias("provider"), F.when(F.col("n_chars") > 1000, "download_pdf").otherwise("read_metadata").alias("action"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("ingest"))
    named = triage.ingestible(decisions, first).select("doc_id", "provider")
    return named.unionByName(triage.ingestible(decisions).select("doc_id", F.lit("any").alias("provider")))


@query("""
WITH s AS (SELECT DISTINCT source AS source_id FROM documents WHERE source IS NOT NULL UNION SELECT r_name FROM region),
i AS (SELECT source AS source_id, count(*) AS insights, array_to_string(list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)), ',') AS types FROM documents GROUP BY 1)
SELECT source_id, coalesce(insights, 0) AS insights, coalesce(types, '') AS types FROM s LEFT JOIN i USING (source_id)
""")
def insights_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Insights (documents) of each source and their types (languages); regions are sources without any."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("insight_type"))
    sources = docs.where("source_id is not null").select("source_id").unionByName(table(spark, d, "region").select(F.col("r_name").alias("source_id"))).distinct()
    return catalog.insight_counts(sources, docs).select("source_id", "insights", F.array_join("insight_types", ",").alias("types"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts (documents) whose path is among the parsed ones (labelled documents)."""
    docs = table(spark, d, "documents").withColumn("local_path", F.concat(F.lit("C:\\Docs\\"), F.col("doc_id").cast("string")))
    paths = catalog.parsed_paths(table(spark, d, "labels").select(F.concat(F.lit("c:/docs/"), F.col("doc_id").cast("string")).alias("source_path")))
    return catalog.parsed_artifacts(docs, paths).select("doc_id", "source")


@query("""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k JOIN labels USING (doc_id) WHERE k.source IS NOT DISTINCT FROM d.source AND k.text = d.text)
""")
def anti_new_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks (documents) that are not known yet; known are the labelled ones. Pages are missing, and equal as such."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_file"), F.lit(None).cast("int").alias("page"), "text")
    return catalog.new_blocks(docs, docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id")).select("doc_id")


@query("""
WITH s AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT source AS source_file, doc_id, 'section' AS kind FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
UNION ALL SELECT source, doc_id, 'block' FROM documents WHERE source NOT IN (SELECT source FROM s)
""")
def effective_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Sections (toxic documents) where a file (source) has some, else its text blocks."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_file"), "doc_id")
    sections = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("source_file", "doc_id", F.lit("section").alias("kind"))
    return catalog.prefer_sections(docs.withColumn("kind", F.lit("block")), sections).select("source_file", "doc_id", "kind")


@query("""
SELECT doc_id, CAST(n_chars AS BIGINT) AS v, 'old' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, CAST(quality AS BIGINT), 'new' FROM labels
""")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a key are replaced by the new ones of that key (labels over documents)."""
    old = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("v"), F.lit("old").alias("origin"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v"), F.lit("new").alias("origin")).distinct()
    return catalog.replace_by_key(old, new, "doc_id")


@query("""
SELECT event_type AS connector, bool_or(value > 50) AS usable, arg_min('e' || event_id, event_id) FILTER (value <= 50) AS first_error,
  (SELECT string_agg(CASE WHEN v > 50 THEN 'completed' ELSE 'failed' END, '|' ORDER BY i) FROM (SELECT event_id AS i, value AS v FROM events x WHERE x.event_type = e.event_type ORDER BY event_id LIMIT 4)) AS statuses
FROM events e GROUP BY event_type
""")
def connector_usability(spark: SparkSession, d: str) -> DataFrame:
    """Whether a connector (event type) was of use, its first four states and its first error."""
    ok = F.col("value") > 50
    runs = table(spark, d, "events").select(F.col("event_type").alias("connector"), F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, F.concat(F.lit("e"), "event_id")).alias("error"), F.col("event_id").alias("ordinal"))
    return catalog.connector_usability(runs).withColumn("statuses", F.array_join("statuses", "|"))


@query("""
SELECT c_custkey, c_nationkey AS source_id, 'NATION_' || c_nationkey AS source_title, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 3 END AS tier FROM customer
""")
def evidence_top1_tiered(spark: SparkSession, d: str) -> DataFrame:
    """The source of each record by tiers: customers look for their nation by title, by file name or by a word of the title."""
    sources = table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("title"), F.array(F.concat(F.lit("in/"), "n_name", F.lit(".PDF"))).alias("paths"), F.col("n_nationkey").alias("ordinal"))
    name = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("record_id"), F.when(F.col("c_acctbal") > 5000, F.lower(name)).alias("paper_title"),
        F.when(F.col("c_acctbal") > 5000, "none").when(F.col("c_acctbal") > 0, F.concat(F.lit("other\\"), name, F.lit(".pdf"))).otherwise(name).alias("source_file"),
    )
    return evidence.match_sources(customers, sources).withColumnRenamed("record_id", "c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_suppkey * 10 + CASE WHEN day(l_shipdate) <= 10 THEN 0 WHEN day(l_shipdate) <= 20 THEN 1 ELSE 2 END AS BIGINT) AS section_id, count(*) AS n FROM lineitem WHERE day(l_shipdate) <= 28 GROUP BY ALL
""")
def section_range_join(spark: SparkSession, d: str) -> DataFrame:
    """The section of each record by its page: lines look for the third of their supplier's month that their day is in."""
    li = table(spark, d, "lineitem")
    sections = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source_file"), F.col("s_suppkey"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(1, 10), (11, 20), (21, 28)])))).alias("p"))
    sections = sections.select("source_file", (F.col("s_suppkey") * 10 + F.col("p.i")).cast("long").alias("section_id"), F.lit("t").alias("section_title"), F.lit("").alias("text"), F.col("p.a").alias("page_start"), F.col("p.b").alias("page_end"), F.col("p.i").alias("ordinal"))
    # a record is a distinct (order, line, supplier, day): the lookup does not depend on anything else
    rows = li.groupBy("l_orderkey", "l_linenumber", "l_suppkey", F.dayofmonth("l_shipdate").alias("page")).agg(F.count("*").alias("m"))
    rows = rows.select("*", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "page").alias("record_id"), F.concat(F.lit("s"), "l_suppkey").alias("source_file"), F.lit(None).cast("string").alias("evidence_text"))
    met = rows.join(evidence.match_sections(rows, sections), "record_id")
    return met.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "section_id").agg(F.sum("m").alias("n"))


@query("""
WITH p AS (SELECT l_suppkey AS f, l_linenumber AS p, min(l_orderkey * 100 + l_linenumber) AS t FROM lineitem GROUP BY 1, 2)
SELECT o.o_orderkey, p.t AS table_id, true AS same_page FROM orders o JOIN p ON p.f = o.o_custkey AND p.p = length(o.o_orderpriority) - 4
""")
def evidence_table_on_page(spark: SparkSession, d: str) -> DataFrame:
    """The first table of each record's page: orders look for lines of the supplier that has their customer's number."""
    tables = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_file"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("table_id"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("x/"), F.col("o_custkey").cast("string")).alias("source_file"), (F.length("o_orderpriority") - 4).alias("page"))
    return evidence.match_on_page(rows, tables, "table_id").withColumnRenamed("record_id", "o_orderkey")


@query("""
SELECT source AS source_file, lang AS source_path, 'html' AS source_type, count(DISTINCT length(source)) AS pages, CAST(count(*) FILTER (n_chars > 1000) AS BIGINT) AS tables FROM documents GROUP BY 1, 2
""")
def source_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What came from each file and path: documents as blocks, the long ones as tables, too."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("source_path"), F.lit("html").alias("source_type"), F.length("source").alias("page"), F.col("doc_id").alias("ordinal"), "n_chars")
    found = evidence.source_summaries(docs, docs.where("n_chars > 1000"), docs)
    return found.select("source_file", "source_path", "source_type", F.size("pages").cast("long").alias("pages"), "tables")


QUESTION = "The red widget and the cold anvil from old data"


def _part_sources(spark: SparkSession, d: str) -> DataFrame:
    """Parts as found sources: the type tells the provider, the brand the kind, the size the files."""
    provider = F.when(F.col("p_type") == "STANDARD", " arXiv").when(F.col("p_type") == "MEDIUM", "openalex").when(F.col("p_type") == "PROMO", "zenodo").when(F.col("p_type") == "SMALL", "github").when(F.col("p_type") == "LARGE", "crossref")
    size = F.when(F.col("p_size") > 5, F.col("p_size").cast("long") * 1_000_000)
    file = F.struct(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".CSV").otherwise(".bin")).alias("name"), F.lit(None).cast("string").alias("type"), size.alias("size"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("source_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("string").alias("url"), F.when(F.col("p_brand") == "Brand#1", "dataset").otherwise("paper").alias("source_type"), (F.col("p_size") / 50.0).alias("confidence"), provider.alias("provider"),
        F.when(F.col("p_size") > 10, "http://x/y.pdf").alias("pdf_url"), F.lit(None).cast("array<string>").alias("keywords"), F.when(F.col("p_size") > 3, F.array(file)).alias("files"), F.col("p_size").cast("long").alias("size"),
    )


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower('{}'), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ('paper', 'dataset', 'source', 'data', 'the', 'and', 'with', 'from')))".format(QUESTION)
_SCORE = f"""greatest(0.0, least(1.0, (p_size / 50.0) * CAST(0.55 AS DOUBLE) + len(list_filter({_TOKENS}, lambda x: list_contains(string_split(p_name, ' '), x))) / len({_TOKENS}) * CAST(0.37 AS DOUBLE) + CASE WHEN p_type IN ('MEDIUM') THEN CAST(0.08 AS DOUBLE) ELSE 0.0 END))"""


@query(f"SELECT p_partkey, round({_SCORE}, 6) AS score FROM part")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    """How well each source fits a question: its confidence, the words in common, and its provider."""
    rows = _part_sources(spark, d)
    score = relevance(F.col("confidence"), topic_tokens(F.lit(QUESTION)), topic_tokens(F.col("title")), F.col("provider"))
    return rows.select(F.col("source_id").alias("p_partkey"), F.round(score, 6).alias("score"))


_ACTION = """CASE WHEN p_type IN ('STANDARD', 'MEDIUM') AND p_size > 10 THEN CASE WHEN taken THEN 'download_pdf' ELSE 'read_metadata' END WHEN p_type IN ('MEDIUM', 'LARGE') THEN 'read_metadata' WHEN p_type = 'SMALL' THEN 'read_readme'
  WHEN p_type = 'PROMO' THEN CASE WHEN p_size <= 3 THEN 'read_file_manifest' WHEN p_size % 2 = 0 AND (p_size <= 5 OR p_size * 1000000 <= 10485760) THEN 'download_small_table' WHEN p_size * 1000000 > 52428800 AND p_size > 5 THEN 'ask_user' ELSE 'read_file_manifest' END
  WHEN p_brand = 'Brand#1' THEN 'read_file_manifest' ELSE 'record_only' END"""


@query(f"""
WITH s AS (SELECT *, {_SCORE} AS score FROM part), r AS (SELECT p_partkey, row_number() OVER (ORDER BY score DESC, p_partkey) AS n FROM s WHERE p_type IN ('STANDARD', 'MEDIUM') AND p_size > 10),
t AS (SELECT s.*, coalesce(n <= 40, false) AS taken FROM s LEFT JOIN r USING (p_partkey)), a AS (SELECT *, {_ACTION} AS action FROM t)
SELECT p_partkey, action, action IN ('download_pdf', 'download_small_table') AS ingest, CASE WHEN action = 'download_pdf' THEN 'medium' WHEN sz IS NULL THEN 'unknown' WHEN sz <= 10485760 THEN 'low' WHEN sz <= 52428800 THEN 'medium' ELSE 'high' END AS cost FROM
 (SELECT *, CASE WHEN p_size > 5 THEN p_size * 1000000 WHEN p_size > 3 THEN NULL WHEN p_type = 'PROMO' THEN NULL ELSE p_size END AS sz FROM a)
""")
def triage_actions(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each source, PDFs for the forty best (a budget is the feature)."""
    return triage.triage(_part_sources(spark, d), QUESTION, 40).select(F.col("source_id").alias("p_partkey"), "action", "ingest", "cost")


@query("""
SELECT p_partkey, coalesce(n <= 25, false) AS taken FROM part LEFT JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_size > 10) USING (p_partkey)
""")
def triage_budget_topk(spark: SparkSession, d: str) -> DataFrame:
    """Which eligible rows are within a budget of 25 (the budget is the feature)."""
    rows = table(spark, d, "part").withColumn("source_id", F.col("p_partkey"))
    return triage.take_best(rows, F.col("p_size") > 10, [F.desc("p_retailprice"), F.col("p_partkey")], 25).select("p_partkey", "taken")


@query("SELECT user_id AS source_id, arg_min(event_type, (-value, event_id)) AS decision, max(value) AS priority_score FROM events GROUP BY 1")
def best_selection_per_source(spark: SparkSession, d: str) -> DataFrame:
    """One decision a source (user): that of the highest score, the earliest of equals."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("decision"), F.col("value").alias("priority_score"), F.col("event_id").alias("ordinal"))
    return triage.best_selections(rows).select("source_id", "decision", "priority_score")


@query("""
WITH t AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT o_orderkey AS source_id, round(least(1.0, 0.3 + 0.1 + least(0.2, o_custkey / 1000.0)), 4) AS score FROM t ORDER BY score DESC, o_custkey DESC, o_orderkey DESC LIMIT 60
""")
def replacement_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Sixty papers (orders) to try after twenty failed downloads; those of some customers were attempted."""
    orders = table(spark, d, "orders")
    rows = orders.select(
        F.col("o_custkey"), F.col("o_orderkey").alias("source_id"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("title"), F.lit("u").alias("pdf_url"), F.lit("crossref").alias("provider"), F.lit("paper").alias("source_type"), F.lit(0.3).alias("confidence"),
        F.col("o_custkey").cast("double").alias("citation_count"), F.when(F.col("o_orderstatus") == "F", "Reject").alias("selection_decision"),
    )
    tried = orders.join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("source_id"))
    return triage.replacements(rows, tried, 20).select("source_id", "score")


@query("""
SELECT page_id, CASE WHEN NOT regexp_matches(u, '^https?:') THEN 'scheme is not http or https' WHEN contains(u, '@') THEN 'user information in the URL' WHEN regexp_matches(u, '//(10|127)\\.') THEN 'private or reserved address' END AS problem
FROM (SELECT page_id, CASE WHEN contains(url, 'blog') THEN replace(url, '://', '://me@') WHEN contains(url, '/de/') THEN 'ftp' || url WHEN contains(url, '/fr/') THEN 'https://10.1.2.3/' ELSE url END AS u FROM pages)
""".replace("\\\\", "\\"))
def public_url_guard(spark: SparkSession, d: str) -> DataFrame:
    """Which URLs must not be fetched, and why; some pages get a URL of a kind that is refused."""
    url = F.col("url")
    odd = F.when(F.contains(url, F.lit("blog")), F.replace(url, F.lit("://"), F.lit("://me@"))).when(F.contains(url, F.lit("/de/")), F.concat(F.lit("ftp"), url)).when(F.contains(url, F.lit("/fr/")), "https://10.1.2.3/").otherwise(url)
    return table(spark, d, "pages").select("page_id", guards.url_problem(odd).alias("problem"))


@query("""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, sum(n_chars * 10000) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents)
SELECT doc_id, CASE WHEN n > 20 THEN 'too many files' WHEN n_chars * 10000 > 52428800 THEN 'file too large' WHEN s > 209715200 THEN 'request too large' WHEN text IS NOT NULL AND length(text) = 0 THEN 'empty file' END AS problem FROM u
""")
def upload_admission(spark: SparkSession, d: str) -> DataFrame:
    """Which uploads may come in: documents of a source are one request, each character stands for 10 kB."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("request_id"), F.col("doc_id").alias("ordinal"), F.lit("a.txt").alias("path"), (F.col("n_chars") * 10000).alias("length"), F.encode("text", "UTF-8").alias("content"))
    return guards.admit(rows).select("doc_id", "problem")


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.html?$') THEN 'html' ELSE 'unknown' END AS kind FROM pages
""")
def artifact_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each page's artifact by the ending of its URL."""
    return table(spark, d, "pages").select("page_id", catalog.artifact_kind(F.col("url")).alias("kind"))
