"""A table that a stream keeps up to date: each batch makes a new version, published with the batch's number."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from attestor.sources.commit import current, drop, publish

#: (what the table held, or None, and a batch) to what it holds now.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """The version that was published last; None before the first batch."""
    now = current(spark, path)
    return spark.read.parquet(f"{path}/{now['version']}") if now else None


def apply(path: str, batch: DataFrame, number: int, merge: Merge) -> bool:
    """Bring a batch into the table; whether it was new.

    A batch whose number was published already changes nothing, so one that is replayed after a failure counts once. The new version is written aside and takes the
    old one's place when the manifest names it; the old one stays for its readers until the next batch.
    """
    spark = batch.sparkSession
    now = current(spark, path)
    if now and number <= now["batch"]:
        return False
    version = f"version-{number}-{uuid.uuid4().hex}"
    merge(state(spark, path), batch).write.parquet(f"{path}/{version}")
    publish(spark, path, {"version": version, "batch": number, "before": now and now["version"]})
    if now and now.get("before"):
        drop(spark, path, now["before"])
    return True


def upserts(stream: DataFrame, path: str, merge: Merge, checkpoint: str) -> DataStreamWriter:
    """A writer of ``stream`` into the table at ``path``, to be started by the caller."""
    return stream.writeStream.foreachBatch(lambda batch, number: apply(path, batch, number, merge)).option("checkpointLocation", checkpoint)
