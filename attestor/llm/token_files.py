"""Token-id files: flat unsigned integers with 64-bit document offsets, made to be memory-mapped.

A data set is a folder with, for each part ``p``:

* ``ids-p.u2`` or ``ids-p.u4``: the ids of the part's documents, one after the other, little-endian unsigned integers of 16
  bits where the vocabulary fits them, else of 32;
* ``offsets-p.bin``: for each document the number of ids of all documents before it, in all parts, and at the
  end the part's own end; little-endian unsigned 64-bit;
* ``docs-p.bin``: the document ids, little-endian signed 64-bit.

Documents ascend by id, within a part and from part to part.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.shared import text_chunks
from attestor.llm.token_ids import binary_rows, little, load

#: Documents in one part file, about; bounds of parts are quantiles of ids, found for so many parts at once.
PART_DOCS, MOST_PARTS = 8192, 10_000
#: Documents that are read back at a time.
READ_DOCS = 1024


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path that executors share; a plain path is a mounted one."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class _Draft:
    """A file that is written beside its place and then renamed, so that a task which is run twice leaves one whole file."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.store, self.path, self.draft = store, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = store.open_output_stream(self.draft, compression=None, buffer_size=1 << 20)

    def publish(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)


class _PartWriter:
    """Writes the documents of one part as they come; nothing but the running count is held."""

    def __init__(self, folder: str, part: int, width: str) -> None:
        store, path = _store(folder)
        self.part, self.docs, self.total = part, 0, 0
        self.files = [_Draft(store, f"{path}/{name}") for name in (f"ids-{part:06d}.{width}", f"docs-{part:06d}.bin", f"ends-{part:06d}.bin")]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs += 1
        self.total += len(ids)
        for file, data in zip(self.files, (ids, np.array([-(1 << 63) if doc_id is None else doc_id], "<i8"), np.array([self.total], "<u8")), strict=True):
            file.out.write(data)

    def close(self) -> tuple[int, int, int]:
        for file in self.files:
            file.publish()
        return self.part, self.docs, self.total


def mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's integers: memory-mapped where the store is a mounted folder, else read."""
    if isinstance(store, fs.LocalFileSystem):
        if not store.get_file_info(path).size:
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


class IdRanges:
    """Ranges of a part's ids, in the width that its file has: memory-mapped where the store is a mounted folder, else only they are read."""

    def __init__(self, store: fs.FileSystem, path: str, part: int) -> None:
        narrow = f"{path}/ids-{part:06d}.u2"
        is_narrow = store.get_file_info(narrow).type != fs.FileType.NotFound
        self.path, self.dtype = (narrow, np.dtype("<u2")) if is_narrow else (f"{path}/ids-{part:06d}.u4", np.dtype("<u4"))
        local = isinstance(store, fs.LocalFileSystem)
        self.whole, self.file = (mapped(store, self.path, self.dtype), None) if local else (None, store.open_input_file(self.path))

    def __getitem__(self, bounds: slice) -> np.ndarray:
        if self.whole is not None:
            return self.whole[bounds]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(size * (bounds.stop - bounds.start), size * bounds.start), self.dtype)


def _bounds(ids: DataFrame) -> np.ndarray:
    """Ids that end the parts, so that parts ascend by id and hold about as many documents each.

    They are quantiles of the id column alone, so that no text is read for them. Beyond ``MOST_PARTS`` parts, each stretch between two
    quantiles is cut again by its own quantiles, so parts stay small however many documents there are. Only 8 bytes a part come here.
    """
    parts = max(1, -(-ids.count() // PART_DOCS))
    coarse = min(parts, MOST_PARTS)
    found = _quantiles(ids, coarse).first().b if coarse > 1 else []
    bounds = np.unique(np.array(found or [], "i8"))
    each = -(-parts // coarse)
    if each > 1:
        known = bounds.tolist()
        inside = ids.where("id is not null").withColumn("stretch", F.pandas_udf(lambda s: s.map(lambda i: bisect_left(known, i)), "int")("id"))
        rows = inside.groupBy("stretch").agg(F.percentile_approx("id", [i / each for i in range(1, each)], max(10000, 20 * each)).alias("b")).collect()
        bounds = np.unique(np.concatenate([bounds, *(np.array(r.b, "i8") for r in rows)]))
    return bounds


def _quantiles(ids: DataFrame, parts: int) -> DataFrame:
    return ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], max(10000, 20 * parts)).alias("b"))


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, add the end id and write the files of this module below ``folder``, which all executors share.

    Returns (part, docs, start, ids) of each part. Null texts count as empty and have the end id alone; rows of
    equal ids are ordered by their ids' bytes; a null id is written as the least 64-bit integer. An empty table
    writes no part. Ids are made before the shuffle by part; each part is written by one task of its own, and
    the bases of the parts are prefix sums of their counts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bounds = _bounds(rows.select("id"))
    parts = len(bounds) + 1
    narrow = load(tokenizer).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for piece, raw, at in text_chunks(batches, "text"):
            ids = binary_rows(*encoder.encode_rows(raw, at, end=True))
            part = np.searchsorted(bounds, piece.column(0).fill_null(-(1 << 63)).to_numpy())  # null ids come first
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), piece.column(0), ids], names=["part", "id", "ids"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now = [], None
        for batch in batches:
            for p, i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if now is None or p != now.part:
                    made += [now.close()] if now else []
                    now = _PartWriter(folder, p, narrow[1:])
                now.add(i, np.frombuffer(data.as_buffer(), narrow))
        made += [now.close()] if now else []
        columns = zip(*made, strict=True) if made else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["part", "docs", "ids"])

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, start in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, path = _store(folder)
                if store.get_file_info(f"{path}/ends-{p:06d}.bin").type == fs.FileType.NotFound:
                    continue  # an earlier run of this task got as far as the offsets
                ends = mapped(store, f"{path}/ends-{p:06d}.bin", "<u8")
                file = _Draft(store, f"{path}/offsets-{p:06d}.bin")
                file.out.write(np.append(np.zeros(1, "<u8"), ends) + np.uint64(start))
                file.publish()
                store.delete_file(f"{path}/ends-{p:06d}.bin")
            yield batch

    spark = docs.sparkSession
    encoded = rows.mapInArrow(encode, "part int, id long, ids binary").repartitionById(parts, F.col("part"))
    sizes = encoded.sortWithinPartitions("part", F.col("id").asc_nulls_first(), "ids").mapInArrow(put, "part int, docs long, ids long").collect()
    base, table = 0, []
    for r in sorted(sizes):  # one row a part, so the prefix sums are small
        table.append((r.part, r.docs, base, r.ids))
        base += r.ids
    schema = "part int, docs long, start long, ids long"
    known = spark.createDataFrame(table, schema)
    spread = known.repartitionById(max(1, min(len(table), 4 * spark.sparkContext.defaultParallelism)), F.col("part"))
    spread.mapInArrow(offsets, schema).write.format("noop").mode("overwrite").save()
    return known


def read(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; ``parts`` names them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                store, path = _store(folder)
                ids = IdRanges(store, path, p)
                docs = mapped(store, f"{path}/docs-{p:06d}.bin", "<i8")
                at = mapped(store, f"{path}/offsets-{p:06d}.bin", "<u8").astype("i8")
                for first in range(0, len(docs), READ_DOCS):
                    some, bounds = np.asarray(docs[first : first + READ_DOCS]), at[first : first + READ_DOCS + 1]
                    own = (bounds - at[0]).tolist()
                    crc = [zlib.crc32(little(ids[a:b])) for a, b in zip(own, own[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == -(1 << 63)), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, parts.count())
    return parts.select("part").repartitionById(n, F.col("part")).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(folder: str, part: int, at: int) -> np.ndarray:
    """The ids of one document of a part, memory-mapped: nothing else of the file is read."""
    store, path = _store(folder)
    offsets = mapped(store, f"{path}/offsets-{part:06d}.bin", "<u8")
    base = int(offsets[0])
    return IdRanges(store, path, part)[int(offsets[at]) - base : int(offsets[at + 1]) - base]
