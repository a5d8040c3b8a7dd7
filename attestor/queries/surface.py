"""Operators called from SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.functions import sql
from attestor.queries.base import query, table


def _ready(spark: SparkSession, d: str, *names: str) -> None:
    sql.register(spark)
    for name in names:
        table(spark, d, name).createOrReplaceTempView(f"given_{name}")


@query("""
SELECT p_partkey, metric, count(*) AS n, sum(value) AS total FROM (SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) GROUP BY 1, 2
""")
def sql_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of parts as metrics, by a table function whose columns follow the table."""
    _ready(spark, d, "part")
    return spark.sql("SELECT p_partkey, metric, count(*) AS n, sum(value) AS total FROM unpivot_metrics(TABLE(given_part), 'p_partkey') GROUP BY p_partkey, metric")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, event_id, i // 80 + 1 AS batch, i % 80 + 1 AS place FROM r
""")
def sql_row_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user in batches of eighty, by a table function over partitions in order."""
    _ready(spark, d, "events")
    return spark.sql("SELECT * FROM row_batches(TABLE(SELECT user_id, event_id, ts FROM given_events) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id, event_id', 80)")


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS nth, md5(substr(text, i * 4500 + 1, 4500)) AS digest FROM (SELECT doc_id, text, unnest(range((length(text) + 4499) // 4500)) AS i FROM documents WHERE text <> '')
""")
def sql_cut_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in parts of 4500 characters, by a table function."""
    _ready(spark, d, "documents")
    return spark.sql("SELECT doc_id, nth, md5(part) AS digest FROM cut_texts(TABLE(given_documents), 'doc_id', 'text', 4500)")
