"""Questions, search plans, ingestion routes, flat rows of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import planning
from attestor.queries.base import query, table

_DOMAINS = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in planning.DOMAIN_WORDS)


@query(f"""
WITH q AS (SELECT p_partkey, lower(p_name || CASE WHEN p_type = 'PROMO' THEN ' Catalyst' WHEN p_type = 'SMALL' THEN ' Benchmark' WHEN p_type = 'LARGE' THEN ' light curve' ELSE '' END) AS t FROM part)
SELECT p_partkey, CASE {_DOMAINS} ELSE 'general science' END AS domain FROM q
""")
def question_domains(spark: SparkSession, d: str) -> DataFrame:
    """The domain of each question, made of part names and types."""
    kind = F.col("p_type")
    tail = F.when(kind == "PROMO", " Catalyst").when(kind == "SMALL", " Benchmark").when(kind == "LARGE", " light curve").otherwise("")
    return table(spark, d, "part").select("p_partkey", planning.domain(F.concat("p_name", tail)).alias("domain"))


@query("""
SELECT p_partkey AS request_id, CASE WHEN p_brand = 'Brand#1' THEN 'bolts' WHEN p_size < 10 THEN 'rings' WHEN contains(p_name, 'bolt') THEN 'bolts' WHEN contains(p_name, 'ring') THEN 'rings' END AS group_id FROM part
""")
def search_request_groups(spark: SparkSession, d: str) -> DataFrame:
    """The field group that each request (part) serves: by id, by a field in common (small ones), or by its text."""
    groups = spark.createDataFrame([("bolts", "bolt"), ("bolts", "hex_bolt"), ("rings", "ring"), ("rings", "ring size")], "group_id string, field string")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("request_id"), F.lit("openalex").alias("connector"), F.col("p_name").alias("query"), F.lit(None).cast("string").alias("purpose"), F.when(F.col("p_brand") == "Brand#1", " Bolts").alias("group_id"),
        F.when(F.col("p_size") < 10, F.array(F.lit("Ring Size"))).alias("fields"),
    )
    return planning.assign_groups(rows, groups).select("request_id", "group_id")


@query("""
SELECT doc_id AS source_id, CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN CASE WHEN source = 'src1' THEN 'error' ELSE 'download' END WHEN lang = 'es' THEN 'readme' ELSE 'metadata' END AS route FROM documents
""")
def ingest_routes(spark: SparkSession, d: str) -> DataFrame:
    """What reading each source (document) comes to, by its action (language)."""
    lang = F.col("lang")
    action = F.when(lang == "fr", "skip").when(lang == "de", "download_pdf").when(lang == "es", "read_readme").otherwise("record_only")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), action.alias("action"), F.lit("zenodo").alias("provider"), F.when(F.col("source") != "src1", F.col("source")).alias("url"))
    return planning.ingest_routes(rows).select("source_id", "route")


@query("SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS chars, left(text, 1200) AS preview FROM documents")
def section_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Sections (documents) without their text: its length and its beginning."""
    return planning.section_payload(table(spark, d, "documents").select("doc_id", "lang", "text"))


@query("""
WITH p AS (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2)
SELECT user_id AS source_id, any_value(k) AS k, string_agg(event_type, '|' ORDER BY pos) AS urls FROM p JOIN (SELECT user_id, arg_min(json_extract_string(props, '$.k'), event_id) AS k FROM events GROUP BY 1) USING (user_id) GROUP BY 1
""")
def combined_source_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Provider records (events) of a source (user) as one view: the first value of a key, URLs (types) united in order."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("ordinal"), F.from_json("props", "map<string,string>").alias("metadata"), F.array("event_type").alias("urls"), F.array().cast("array<string>").alias("paths"))
    return planning.combined_metadata(rows).select("source_id", F.element_at("metadata", "k").alias("k"), F.array_join("urls", "|").alias("urls"))
