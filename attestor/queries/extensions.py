"""What Spark offers beyond the operators themselves: cubes, rollups, as-of joins over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.extensions import as_of
from attestor.queries.base import query, table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def histogram_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts by two states, and all their totals."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Customers by region and nation, with totals."""
    met = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("""
SELECT p.event_id, v.event_id AS seen_id, v.ts AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts
""")
def as_of_last_view(spark: SparkSession, d: str) -> DataFrame:
    """The last view of a user before each purchase."""
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"))
    found = as_of(events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", {"seen_id": "seen_id", "ts": "seen"})
    return found.select("event_id", "seen_id", "seen")
