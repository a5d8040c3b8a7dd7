"""Clusters of provider records that describe one source, and the merge of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import norm_key
from attestor.functions.values import json_held, json_plain

#: Fields that describe the merge itself and are never compared.
OWN_FIELDS = ("provider", "source_records", "source_ids", "providers", "alternate_urls", "source_conflicts")


def components(sources: DataFrame, id_col: str = "source_id", keys_col: str = "keys") -> DataFrame:
    """(id, root): sources that share a key, directly or over others; the root is the least id.

    Each round passes the least root over the keys and back, two aggregates with partial sums, so a key that many
    records share is no burden. Rounds end when nothing changes; each is cut off by a reliable checkpoint.
    """
    set_folder(sources.sparkSession)
    links = sources.select(F.col(id_col).alias("id"), F.explode(keys_col).alias("key")).distinct().checkpoint()
    now = sources.select(F.col(id_col).alias("id"), F.col(id_col).alias("root")).distinct()
    while True:
        by_key = links.join(now, "id").groupBy("key").agg(F.min("root").alias("root"))
        by_id = links.join(by_key, "key").groupBy("id").agg(F.min("root").alias("least"))
        met = now.join(by_id, "id", "left").select("id", "root", F.least("root", "least").alias("new")).checkpoint()
        # the root's own root: halves the length of chains
        jump = met.join(met.select(F.col("id").alias("_i"), F.col("new").alias("_n")), F.col("new") == F.col("_i"), "left").select("id", F.coalesce("_n", "new").alias("root"), F.col("root").alias("old"))
        now = jump.checkpoint()
        if not now.where("root <> old").limit(1).count():
            return now.select("id", "root")
        now = now.select("id", "root")


def set_folder(spark) -> None:
    """Have reliable checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))


def shared_base(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode without the setting, as in tests, a folder of this machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    import tempfile

    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="attestor-")


def greedy_clusters(sources: DataFrame, rooted: DataFrame) -> DataFrame:
    """(id, cluster): clusters as they come out when records are added one by one, whatever the size of a component.

    ``sources`` has (source_id, keys, ordinal). A record joins the cluster that its first known key leads to and brings its other
    keys along; a record that would bridge two clusters does not merge them. Only records of one component can meet. A key leads
    to the cluster of the first record that has it, so a record follows that record of its first key which an earlier one
    has, and clusters are the ends of these paths: aggregates by key and rounds that halve the paths, no replay of a component.
    """
    set_folder(sources.sparkSession)
    # the place of a record in the order: never null, ties by id
    place = F.struct(F.isnull("ordinal").alias("none"), "ordinal", "id")
    met = sources.select(F.col("source_id").alias("id"), "keys", "ordinal").join(rooted, "id").select("id", "root", place.alias("at"), "keys").checkpoint()
    keyed = met.select("root", "at", F.posexplode("keys").alias("nth", "key")).where("key is not null")
    first = keyed.groupBy("root", "key").agg(F.min("at").alias("first"))
    known = keyed.join(first, ["root", "key"]).where("first < at").groupBy("at").agg(F.min(F.struct("nth", "first"))["first"].alias("up"))
    now = met.select("at").distinct().join(known, "at", "left").select("at", F.coalesce("up", "at").alias("up")).checkpoint()
    while True:
        ahead = now.where("up <> at").select(F.col("at").alias("_at"), F.col("up").alias("_up"))
        now = now.join(ahead, F.col("up") == F.col("_at"), "left").select("at", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")).checkpoint()
        if not now.where("moved").limit(1).count():
            return met.select("at", "id").join(now, "at").select("id", F.col("up.id").alias("cluster"))
        now = now.select("at", "up")


def merge_clusters(sources: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, source_id, n_records, providers, confidence, metadata): the first value of each field, and the most confidence.

    ``sources`` has (source_id, provider, confidence, ordinal, metadata MAP<STRING, JSON text>).
    """
    met = sources.join(clustered.withColumnRenamed("id", "source_id"), "source_id")
    lead = met.groupBy("cluster").agg(F.min_by("source_id", "ordinal").alias("source_id"), F.count("*").alias("n_records"), F.max("confidence").alias("confidence"))
    places = met.where("provider <> ''").groupBy("cluster", "provider").agg(F.min("ordinal").alias("at"))
    providers = places.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "provider"))), lambda p: p["provider"]).alias("providers"))
    values = met.select("cluster", "ordinal", F.explode("metadata").alias("name", "value")).where(json_held(F.col("value")) & ~F.col("name").isin(*OWN_FIELDS))
    values = values.groupBy("cluster", "name").agg(F.min_by("value", "ordinal").alias("value"))
    values = values.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    return lead.join(providers, "cluster", "left").join(values, "cluster", "left")


def value_conflicts(sources: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, field, n_values, kept): fields on which records of a cluster differ; the first value is the one kept."""
    met = sources.join(clustered.withColumnRenamed("id", "source_id"), "source_id")
    values = met.select("cluster", "ordinal", F.explode("metadata").alias("field", "value")).where(json_held(F.col("value")) & ~F.col("field").isin(*OWN_FIELDS))
    values = values.withColumn("v", norm_key(json_plain(F.col("value"))))
    counted = values.groupBy("cluster", "field", "v").agg(F.min("ordinal").alias("at"))
    found = counted.groupBy("cluster", "field").agg(F.count("*").alias("n_values"), F.min_by("v", "at").alias("kept"))
    return found.where("n_values > 1")


