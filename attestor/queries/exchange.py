"""Answers of catalogue services, files out and in, actions and stages: made of parts and read back."""

from __future__ import annotations

import contextlib
import csv
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.clustering import shared_base
from attestor.plans import manifest, registry
from attestor.queries.base import query, table
from attestor.sources import commit, connectors, delimited, files, sinks


def _answers(spark: SparkSession, d: str, provider: str, payload) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.lit(provider).alias("connector"), payload.alias("payload"))


_SIX = """
SELECT p_partkey AS request_id, 'openalex' AS provider, p_name AS title, '10.1/' || p_partkey AS doi, p_brand AS author, 2000 + p_size AS year, 'paper' AS kind FROM part
UNION ALL SELECT p_partkey, 'crossref', p_name, '10.1/' || p_partkey, 'A ' || p_brand, 2000 + p_size, 'paper' FROM part
UNION ALL SELECT p_partkey, 'semantic_scholar', p_name, '10.1/' || p_partkey, p_brand, 2000 + p_size, 'paper' FROM part
UNION ALL SELECT p_partkey, 'zenodo', p_name, '10.1/' || p_partkey, p_brand, 2000 + p_size, 'dataset' FROM part
UNION ALL SELECT p_partkey, 'figshare', p_name, '10.1/' || p_partkey, NULL, NULL, 'dataset' FROM part
UNION ALL SELECT p_partkey, 'github', p_name, NULL, p_brand, NULL, 'repository' FROM part
UNION ALL SELECT p_partkey, 'arxiv', p_name, NULL, p_brand, 2000 + p_size, 'paper' FROM part
"""


@query(_SIX)
def catalogue_answers(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of seven services, each in its own form, as sources of one form; a broken payload beside each gives none."""
    key, name, brand = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")
    year = (F.col("p_size") + 2000).cast("string")
    doi, one = F.concat(F.lit("10.1/"), key), lambda c, n: F.array(F.struct(c.alias(n)))
    day = F.concat(year, F.lit("-02-03"))
    js = lambda **fields: F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    st = lambda **fields: F.struct(*(c.alias(n) for n, c in fields.items()))
    forms = {
        "openalex": js(results=F.array(st(id=F.concat(F.lit("https://openalex.org/W"), key), display_name=name, doi=doi, publication_year=year.cast("int"), publication_date=day, authorships=one(st(display_name=brand), "author")))),
        "crossref": js(message=st(items=F.array(st(DOI=doi, URL=F.concat(F.lit("https://doi.org/"), doi), title=F.array(name), author=F.array(st(given=F.lit("A"), family=brand)), published=F.struct(F.array(F.array(year.cast("int"), F.lit(2))).alias("date-parts")))))),
        "semantic_scholar": js(data=F.array(st(paperId=key, title=name, url=F.lit("u"), year=year.cast("int"), externalIds=st(DOI=doi), authors=one(brand, "name")))),
        "zenodo": js(hits=st(hits=F.array(st(id=F.col("p_partkey"), doi=doi, links=st(self_html=F.lit("h")), metadata=st(title=name, publication_date=day, creators=one(brand, "name")))))),
        "figshare": F.to_json(F.array(st(id=F.col("p_partkey"), title=name, doi=doi, url_public_html=F.lit("h"), published_date=day))),
        "github": js(items=F.array(st(id=F.col("p_partkey"), full_name=name, html_url=F.lit("h"), updated_at=day, owner=st(login=brand)))),
        "arxiv": F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/2401.1</id><title> "), name, F.lit("\n </title><published>"), day, F.lit("</published><author><name>"), brand, F.lit('</name></author><link href="http://x/p" title="pdf"/></entry></feed>')),
    }
    answers = None
    for provider, payload in forms.items():
        rows = _answers(spark, d, provider, payload).unionByName(_answers(spark, d, provider, F.lit('{"odd": ')))
        answers = rows if answers is None else answers.unionByName(rows)
    found = connectors.map_all(answers)
    return found.select("request_id", "provider", "title", "doi", F.get("authors", F.lit(0)).alias("author"), "year", "kind")


@query("""
SELECT p_partkey AS key FROM part WHERE p_size % 3 <> 0
""")
def uncached_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests without an answer of the last day."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    hours = F.when(F.col("p_size") % 3 == 0, 5).otherwise(25)
    cache = rows.where("p_size % 3 < 2").select("key", F.timestamp_seconds(F.lit(1_700_000_000) - hours * 3600).alias("fetched_at"))
    return connectors.missing_requests(rows.select("key"), cache, now)


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'skip' WHEN 3 THEN 'skip' ELSE 'skip' END AS route, CASE p_size % 5 WHEN 2 THEN 'archive' WHEN 3 THEN 'structured data: use spark.read' WHEN 4 THEN 'unsupported format' END AS skip_reason FROM part
""")
def file_gate(spark: SparkSession, d: str) -> DataFrame:
    """How files are read by their endings, and why some are not."""
    path = F.concat(F.lit("/in/"), "p_partkey", F.get(F.array(*map(F.lit, [".TSV", ".md", ".zip", ".json", ".odd"])), F.col("p_size") % 5))
    return files.gate(table(spark, d, "part").select("p_partkey", path.alias("path"))).select("p_partkey", "route", "skip_reason")


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; it goes when the application ends."""
    path = f"{shared_base(spark).rstrip('/')}/attestor-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@query("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, nullif(source, '') AS source, CAST(length(text) AS VARCHAR) AS n, CASE WHEN doc_id % 2 = 0 THEN '=1+' || doc_id ELSE 'plain "quoted", cell' END AS cell FROM documents
""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as CSV for spreadsheets, with mark and guard, and read back."""
    even = F.col("doc_id") % 2 == 0
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").alias("n"), F.when(even, F.concat(F.lit("=1+"), "doc_id")).otherwise('plain "quoted", cell').alias("cell"))
    folder = _folder(spark)
    sinks.write_csv(rows, f"{folder}/csv")
    return sinks.read_csv(spark, f"{folder}/csv").select("doc_id", "lang", "source", "n", "cell")


def _gb_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CSV lines of a file in GB18030, its header first."""
    head = True
    for batch in batches:
        made = io.StringIO(newline="")
        rows = csv.writer(made, lineterminator="\n")
        if head:
            rows.writerow(batch.schema.names)
        rows.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        head = False
        yield pa.RecordBatch.from_arrays([pa.array([made.getvalue().removesuffix("\n").encode("gb18030")])], names=["line"])


_NOTE = "CASE WHEN o_orderkey % 5 = 0 THEN 'two' || chr(10) || 'lines, \"' || o_orderpriority || '\"' ELSE o_orderpriority END"


@query(f"""
SELECT form, CAST(o_orderkey AS VARCHAR) AS key, note, status, NULL AS error FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, {_NOTE} AS note FROM orders), (SELECT unnest(['mark', 'plain', 'gb18030', 'tab']) AS form)
UNION ALL SELECT 'blank', CAST(o_orderkey AS VARCHAR), o_orderpriority[1:1], nullif(o_orderstatus, 'O'), NULL FROM orders
UNION ALL SELECT 'broken', NULL, NULL, NULL, '{delimited.UNCLOSED}' UNION ALL SELECT 'odd', NULL, NULL, NULL, '{delimited.UNDECODED}'
""")
def mixed_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as CSV with a mark, without, in GB18030, as TSV and as DAT, beside two broken files, and read back by ranges with cells that go over lines."""
    folder, key = _folder(spark), F.col("o_orderkey")
    note = F.when(key % 5 == 0, F.concat(F.lit('two\nlines, "'), "o_orderpriority", F.lit('"'))).otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select(key.cast("string").alias("key"), note.alias("note"), F.col("o_orderstatus").alias("status"), F.lit("材料").alias("名"), F.left("o_orderpriority", F.lit(1)).alias("short"))
    status = F.when(F.col("status") == "O", "N/A").otherwise(F.col("status"))
    rows = rows.withColumn("status", status)
    writer = lambda df, name, **options: df.write.options(header=True, escape='"', **options).csv(f"{folder}/{name}")
    wide = rows.select("key", "note", "status", "名")
    # a column's name with the mark is what a file with a mark begins with
    writer(wide.withColumnRenamed("key", "\ufeffkey"), "mark")
    writer(wide, "plain")
    wide.mapInArrow(_gb_lines, "line binary").select(F.col("line").cast("string")).write.text(f"{folder}/gb18030")
    writer(wide, "tab", sep="\t")
    writer(rows.select("key", "short", "status"), "blank", sep=" ")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    child = lambda path, name: spark._jvm.org.apache.hadoop.fs.Path(path, name)
    for name, end in (("tab", ".tsv"), ("blank", ".dat"), ("gb18030", ".csv")):
        for file in store.listStatus(child(target, name)):
            store.rename(file.getPath(), child(file.getPath().getParent(), file.getPath().getName().rsplit(".", 1)[0] + end))
    for name, content in (("broken.csv", b'key,note,status\n1,"never closed,x\n'), ("odd.csv", b"key,note,status\n\xff\xff\xff,a,b\n")):
        stream = store.create(child(target, name))
        stream.write(bytearray(content))
        stream.close()
    found = delimited.read_ranges(spark, folder)
    form = F.coalesce(F.nullif(F.regexp_extract("source_path", r"/(mark|plain|gb18030|tab|blank)/[^/]+$", 1), F.lit("")), F.regexp_extract("source_file", r"^(\w+)\.", 1))
    value = lambda c: F.try_element_at("values", F.lit(c))
    return found.select(form.alias("form"), value("key").alias("key"), F.coalesce(value("note"), value("short")).alias("note"), value("status").alias("status"), "error")


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id + 1000000000, user_id, 'again' FROM events WHERE event_id % 10 = 0")
def event_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events appended twice to a log of JSON lines, and read back."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    folder = _folder(spark)
    sinks.append_events(events, folder)
    sinks.append_events(events.where("event_id % 10 = 0").select((F.col("event_id") + 1_000_000_000).alias("event_id"), "user_id", F.lit("again").alias("event_type")), folder)
    return spark.read.schema(events.schema).json(folder)


@query("SELECT r_regionkey AS a, r_name AS b, NULL::VARCHAR AS c FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def tables_as_one(spark: SparkSession, d: str) -> DataFrame:
    """All rows of several tables with all their columns."""
    one = table(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b"))
    two = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("c"))
    return sinks.union_tables([one, two]).select("a", "b", "c")


@query("""
WITH a AS (SELECT p_partkey AS artifact_id, (['parse_table', 'parse_csv'])[p_size % 2 + 1] AS action, (['csv', 'pdf', 'image'])[p_size % 3 + 1] AS kind, p_size % 5 = 0 AS ended, p_size % 7 = 0 AS had FROM part)
SELECT action, artifact_id FROM a WHERE NOT ended AND NOT had AND ((action = 'parse_table' AND kind IN (TABLES)) OR (action = 'parse_csv' AND kind IN (CSVS)))
""".replace("TABLES", ", ".join(f"'{k}'" for k in registry.CAPABILITIES["parse_table"])).replace("CSVS", ", ".join(f"'{k}'" for k in registry.CAPABILITIES["parse_csv"])))
def possible_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions that their artifact can take: of the right kind, not at its end, and not done before."""
    size = F.col("p_size")
    action = F.when(size % 2 == 0, "parse_table").otherwise("parse_csv")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), action.alias("action"), F.get(F.array(F.lit("csv"), F.lit("pdf"), F.lit("image")), size % 3).alias("artifact_type"), F.when(size % 5 == 0, "failed").otherwise("downloaded").alias("status"), F.when(size % 7 == 0, F.array(action)).otherwise(F.array().cast("array<string>")).alias("completed_operations"))
    return registry.possible_actions(part.select("action", "artifact_id"), part.drop("action"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'budget is used up' END AS problem FROM part
""")
def action_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Actions whose budget is used up."""
    actions = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "parse_table").when(F.col("p_size") % 3 == 0, "parse_csv").otherwise("read_readme").alias("action"))
    return registry.allowed(actions, {"parse_table": 3, "parse_csv": 3}, spark.createDataFrame([("parse_table", 3), ("parse_csv", 2)], "action string, n int")).select("p_partkey", "problem")


@query("""
SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN ['new ' || p_type, 'also ' || p_type] ELSE [p_type] END) AS query FROM part WHERE p_size % 2 = 0 AND NOT contains(lower(p_type), 'brass')
""")
def filtered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests to allowed services without words to avoid, rewritten ones in the place of their own."""
    revised = F.when(F.col("p_size") % 3 == 0, F.array(F.concat(F.lit("new "), "p_type"), F.concat(F.lit("also "), "p_type"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "arxiv").otherwise("zenodo").alias("connector"), F.col("p_type").alias("query"), revised.alias("revised"))
    return registry.search_requests(rows, ["arxiv"], ["BRASS"]).select("p_partkey", "query")


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that a stage has not done in their present form: some are new, some changed since."""
    now = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    before = now.where("doc_id % 3 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    done = manifest.mark_done(manifest.changed(before, spark.createDataFrame([], manifest.MANIFEST), "parse", "content"), "parse")
    return manifest.changed(now, done, "parse", "content").select("path")


@query("""
SELECT 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'parts', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part UNION ALL SELECT 'after a failure', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
""")
def bundle_published(spark: SparkSession, d: str) -> DataFrame:
    """Two tables published together and read back; a later bundle that fails between its tables leaves them as they were."""
    folder = f"{_folder(spark)}/bundle"
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    commit.write_bundle({"orders": orders.limit(1), "parts": orders.limit(1)}, folder)
    commit.write_bundle({"orders": orders, "parts": table(spark, d, "part").select(F.col("p_partkey").alias("key"))}, folder)
    before = commit.read_bundle(spark, folder)
    broken = orders.select(F.when(F.col("key") >= 0, F.raise_error(F.lit("broken"))).cast("long").alias("key"))
    with contextlib.suppress(Exception):  # what fails here is the point
        commit.write_bundle({"orders": orders.limit(2), "parts": broken}, folder)
    rows = [before["orders"].withColumn("name", F.lit("orders")), before["parts"].withColumn("name", F.lit("parts")), commit.read_bundle(spark, folder)["orders"].withColumn("name", F.lit("after a failure"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("name").agg(F.count("*").alias("n"), F.sum("key").alias("total"))
