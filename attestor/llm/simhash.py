"""SimHash near-duplicate detection by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.graph import components
from attestor.llm.shared import BROADCAST_ROWS, stage, unstage

SEED = 42


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles, unsigned; 0 for a text without words.

    A-Z are lower-cased, words are parted by ASCII white space, shingles are joined by one space and
    hashed with XXH64. A bit is set if it is set in over half of the hashes, repeats included.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) > words else [b" ".join(tokens)]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, "i8"), max(1, len(tokens) - words + 1)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8", n)
    for part in range(0, n, 65536):
        ones += np.unpackbits(hashes[part : part + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, **also: Column) -> DataFrame:
    """(id, fp) and ``also``, which are longs: each row's fingerprint as a signed 64-bit integer. A null text counts as empty."""

    names = ["id", "fp", *also]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), words) for t in batch.column(1)], dtype="u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("i8")), *batch.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in also.items()))
    return rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def ball(fp: str, radius: int) -> F.Column:
    """All 64-bit values within ``radius`` differing bits of column ``fp``, as an array."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << i) for m in masks for i in range(64)} | set(masks))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: F.col(fp).bitwiseXOR(m))


def links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between ``points`` (node, fp), fp distinct, that keep every component at ``radius`` whole.

    Two fingerprints within ``radius`` share a value within half of it of both (an odd radius gives one side
    the larger half, here both get it). Every fingerprint emits its ball, equal values are shuffled
    together, and each one is linked with the next in a value's bucket after a check of their distance:
    for an even radius all members of a bucket are within the radius of each other, so a chain through
    the bucket keeps all of its links' components without emitting all pairs. A bucket has at most as many
    members as a ball has values.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    spread = points.select("node", "fp", F.explode(ball("fp", radius // 2)).alias("value"))
    order = Window.partitionBy("value").orderBy("node")
    chained = spread.select("node", "fp", F.lag("node").over(order).alias("prev"), F.lag("fp").over(order).alias("prev_fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("prev_fp"))) <= radius
    return chained.where(F.col("prev").isNotNull() & near).select(F.col("prev").alias("a"), F.col("node").alias("b"))


def _rooted(points: DataFrame, radius: int) -> DataFrame:
    """Add ``root`` to ``points`` (fp, distinct): the least fingerprint reachable; ids play no part, so they may repeat or be null."""
    roots = components(links(points.select(F.col("fp").alias("node"), "fp"), radius), "a", "b")
    return points.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): ``component`` is the least id reachable through fingerprints that differ in ``radius`` bits at most.

    Every input row gives a row. Null texts count as empty, so they share fingerprint 0, which links like any
    other. Rows with a null id are kept and link like others, with the component of their fingerprint (null if it
    has no id at all). Equal fingerprints are brought together first, so a group of copies costs one row; extra
    columns of any name are ignored. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col, words))
    points = stage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    rooted = stage(_rooted(points, radius))
    # only components of several fingerprints need the least of their ids; they are few, or dealt by AQE
    small = stage(rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component")).where("n > 1").drop("n"))
    shared = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
    component = F.when(F.col("own").isNull(), F.col("least")).otherwise(F.col("component"))
    labelled = stage(rooted.join(shared.withColumnRenamed("root", "own"), F.col("root") == F.col("own"), "left").select("fp", component.alias("component"), "rows"))
    unstage(points, rooted, small)
    # fingerprints of more than a thousandth of the rows are fewer than a thousand: these are broadcast, so no task gets all their rows
    hot = labelled.where(F.col("rows") * 1000 > F.lit(prints.count()))
    often = F.broadcast(hot.select("fp", F.col("component").alias("_c"), F.lit(True).alias("_hot")))
    met = prints.join(often, "fp", "left")
    return met.where("_hot").select("id", "fp", F.col("_c").alias("component")).unionByName(met.where("_hot is null").select("id", "fp").join(labelled.select("fp", "component"), "fp"))


def leads(docs: DataFrame, mark: Column, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, mark, rows): for each component its row of least id, nulls last, and least ``mark``; ``rows`` have both.

    ``mark`` is a hash of a row's content, a long. One key holds a component however ids repeat, since components are of fingerprints.
    """
    prints = stage(fingerprints(docs, id_col, text_col, words, mark=mark))
    counted = prints.groupBy("fp", "id", "mark").agg(F.count("*").alias("rows"))
    points = stage(counted.groupBy("fp").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "mark", "rows")).alias("lead")))
    found = stage(_rooted(points, radius).groupBy("root").agg(F.min("lead").alias("lead")).select("lead.id", "lead.mark", "lead.rows"))
    unstage(prints, points)
    return found
