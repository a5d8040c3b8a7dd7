"""Helpers that several training-data operators share: staging, sampling, and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of about this many bytes and rows, so memory does not follow the batch size.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 256
#: Where each byte takes dozens of bytes of arrays (n-grams, features of words), runs are of about this many.
FEATURE_BYTES = 1 << 18
#: A side of a join is broadcast only when counted to have no more rows than this (about 100 bytes each as a hash table).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can read and write.

    Where the setting is missing (tests in local mode) a temporary folder of this machine serves; on a
    cluster that would lose data, so there a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/attestor-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def passing(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when the application ends, at the latest."""
    store, target = _store(spark, path)
    store.deleteOnExit(target)
    return path


def stage(df: DataFrame, *partition: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    What an operator's result still reads stays until the application ends; the rest goes by :func:`unstage` before.
    """
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*partition).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(passing(df.sparkSession, path))
    out.staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete what :func:`stage` wrote, once nothing reads it any more."""
    for df in staged:
        store, target = _store(df.sparkSession, df.staged_at)
        store.delete(target, True)


def fold(id_col: str, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string")) % n


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones at each run and for each partitioning: those of least hash."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of documents with a label 0 or 1; repeated label rows count once, the larger label holds.

    Labels go to the documents by broadcast while they are counted to be few, else both sides are shuffled.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(known, "id")


def per_class_sample(rows: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each value of ``label`` (all, if fewer), picked by the hash of ``id``; and the counts."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = int(min(1.0, most / n) * (1 << 30))
        keep = F.when(F.col(label) == value, F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).otherwise(keep)
    return rows.where(keep), counts


def utf8_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and each row's bounds in it. Null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, "i8")[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return raw, at


def append_columns(docs: DataFrame, text_col: str, names: list[str], types: list[str], work: Callable[[pa.Array, np.ndarray, np.ndarray], list]) -> DataFrame:
    """Add columns that ``work(texts, bytes, bounds)`` computes for a chunk of rows; null texts come as empty.

    Columns of ``docs`` with these names are replaced, all others stay, whatever they are called.
    """
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, bounds in text_chunks(batches, f"c{at}", FEATURE_BYTES):
            made = work(rows.column(at), raw, bounds)
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, made)], names=[*rows.schema.names, *names])

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)] + [f"{n} {t}" for n, t in zip(names, types, strict=True)])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema).toDF(*docs.columns, *names)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of about ``most`` bytes of text; a longer text is never cut.

    Yields the rows, their bytes and ``n + 1`` bounds that start at 0.
    """
    for batch in batches:
        raw, at = utf8_rows(batch.column(text))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            last = min(last, first + CHUNK_ROWS)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def sums_by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[at[i]:at[i + 1]]`` for each ``i``; an empty stretch sums to 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype="f8")])
    return total[at[1:]] - total[at[:-1]]
