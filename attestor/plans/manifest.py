"""Stage outputs with a manifest: work that was done for the same content is read instead of done again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.identity import fingerprint

VERSION = 1
MANIFEST = "path string, stage string, fingerprint string, version int"


def table_fingerprint(rows: DataFrame) -> str:
    """One digest for the contents of a table, whatever the order of its rows: sums of two row hashes, and their number."""
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})
    total = rows.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((columns, *map(str, total))).encode()).hexdigest()


def changed(files: DataFrame, manifest: DataFrame, stage: str, *columns: str) -> DataFrame:
    """Files whose content is not in the manifest for a stage of this version; ``fingerprint`` is added."""
    marked = files.withColumn("fingerprint", fingerprint(*(F.col(c) for c in columns)))
    done = manifest.where((F.col("stage") == stage) & (F.col("version") == VERSION)).select("path", "fingerprint")
    return marked.join(done, ["path", "fingerprint"], "left_anti")


def mark_done(files: DataFrame, stage: str) -> DataFrame:
    return files.select("path", F.lit(stage).alias("stage"), "fingerprint", F.lit(VERSION).alias("version"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def staged(spark: SparkSession, folder: str, name: str, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """The result of a stage, from ``folder`` if it was made there from the same inputs, else made and written.

    The place is named after the inputs' fingerprints and the version; a half-written result has no mark of success and is made anew.
    """
    key = hashlib.sha256("|".join([str(VERSION), name, *map(table_fingerprint, inputs)]).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def in_order(stages: list[str], done: set[str]) -> str | None:
    """The first stage that has not been done, null when all are."""
    return next((s for s in stages if s not in done), None)
