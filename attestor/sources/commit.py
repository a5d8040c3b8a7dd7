"""Several tables published at once: written under an attempt of their own, then named by one manifest that is swapped by a rename.

A reader resolves the manifest first, so it sees all tables of one attempt, whatever fails or is being written meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_current.json"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> dict | None:
    """What was published last at ``path``; null if nothing was."""
    store, file = _store(spark, path), _path(spark, path, MANIFEST)
    if not store.exists(file):
        return None
    stream = store.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """Put ``content`` in the place of what was published before, in one step."""
    store, new = _store(spark, path), _path(spark, path, f"_new-{uuid.uuid4().hex}")
    stream = store.create(new)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    target = store.makeQualified(_path(spark, path, MANIFEST))
    fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(new), target, how)


def drop(spark: SparkSession, path: str, name: str) -> None:
    _store(spark, path).delete(_path(spark, path, name), True)


def write_bundle(tables: dict[str, DataFrame], path: str) -> str:
    """Write all tables as Parquet under a new attempt and publish them together; the name of the attempt.

    If one fails, nothing is published and its attempt is deleted. The attempt that was current stays for readers that have resolved it; older ones go.
    """
    spark = next(iter(tables.values())).sparkSession
    before, attempt = current(spark, path), f"attempt-{uuid.uuid4().hex}"
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{path}/{attempt}/{name}")
    except Exception:
        drop(spark, path, attempt)
        raise
    publish(spark, path, {"attempt": attempt, "tables": sorted(tables), "before": before and before["attempt"]})
    if before and before.get("before"):
        drop(spark, path, before["before"])
    return attempt


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that were published last, by name; none if nothing was."""
    now = current(spark, path)
    return {name: spark.read.parquet(f"{path}/{now['attempt']}/{name}") for name in now["tables"]} if now else {}
