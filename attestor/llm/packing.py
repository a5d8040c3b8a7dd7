"""Best-fit packing of documents into sequences, by large-item matching on the table of piece lengths.

Lengths are whole numbers up to the capacity, so how many pieces there are of each length says all that the
packing needs: the plan is made on that table, of fixed size, and covers any number of documents. Pieces then
look up their places by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.shared import stage, text_chunks
from attestor.llm.token_ids import little, load

CAPACITY = 2048
#: Pieces of one length are numbered in so many runs, each by a task of its own.
RUNS = 1024

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Bins:
    """``count`` bins of the same content: numbers from ``first`` on, ``used`` tokens each."""

    first: int
    count: int
    used: int


@dataclass
class Slot:
    """Pieces ``rank``.. of ``length`` go to bins from ``bin`` on, ``each`` a bin, the first of a bin at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Places for ``lengths[n]`` pieces of each length ``n`` from 1 to ``capacity``.

    Large pieces, above a third of the capacity, come two to a bin at most: the longest that is left is matched with the
    longest that fits beside it. Smaller pieces, longest first, go to the tightest gap that holds them, and to new
    bins when there is none. Bins of equal content are handled as one, so the work follows the number of
    lengths and not of pieces.
    """
    slots: list[Slot] = []
    gaps: dict[int, list[Bins]] = {}
    order: list[int] = []  # the gaps that there are, ascending
    left = {n: c for n, c in lengths.items() if c}
    taken = dict.fromkeys(left, 0)
    bins = 0

    def opened(b: Bins) -> None:
        gap = capacity - b.used
        if gap and b.count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append(b)

    def place(n: int, count: int, first: int, each: int, offset: int) -> None:
        slots.append(Slot(n, taken[n], count, first, each, offset))
        taken[n] += count
        left[n] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate is None or (mate == n and left[n] == 1):
            # the one that is left of its length may still have a shorter mate
            at = at - 1 if mate == n else at
            mate = large[at] if mate == n and at >= 0 else None
        if mate is None:
            count, used = left[n], n
        else:
            count, used = (left[n] // 2, 2 * n) if mate == n else (min(left[n], left[mate]), n + mate)
        place(n, count, bins, 1, 0)
        if mate is not None:
            place(mate, count, bins, 1, n)
        opened(Bins(bins, count, used))
        bins += count
        large = [m for m in large if left[m]]

    for n in sorted((m for m in left if left[m]), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                full, rest = divmod(left[n], each)
                for count, k in ((full, each), (1, rest)):
                    if count and k:
                        place(n, count * k, bins, k, 0)
                        opened(Bins(bins, count, k * n))
                        bins += count
                continue
            gap = order[at]
            b = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // n
            full = min(b.count, left[n] // each)
            rest = left[n] - full * each if full < b.count and left[n] - full * each < each else 0
            for first, count, k in ((b.first, full, each), (b.first + full, 1 if rest else 0, rest)):
                if count:
                    place(n, count * k, first, k, b.used)
                    opened(Bins(first, count, b.used + k * n))
            used = full + (1 if rest else 0)
            opened(Bins(b.first + used, b.count - used, b.used))
    return slots


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each whole text: its ids and the end id, cut from the back, so that only the first may be shorter.

    Null texts count as empty and give a piece with the end id alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for rows, raw, at in text_chunks(batches, "text"):
            found, bounds = encoder.encode_rows(raw, at, end=True)
            ids, made = little(found), []
            for i, first, last in zip(rows.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                n = last - first
                cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                made += [(i, k, a, b - a, zlib.crc32(ids[4 * (first + a) : 4 * (first + b)])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*made, strict=True) if made else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, PIECE)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``; other columns stay.

    ``cut`` must give the same rows each time it is read (a table, or a staged result). Rows of one length are
    dealt into runs by their hash, each run is numbered from the number of rows in the runs before it, and
    the number leads to a place of the plan. The plan has a row for each bin content, so its size is bounded
    by the capacity and it is broadcast.
    """
    cut = cut.drop("sequence_id", "offset")
    named = [f"c{i}" for i in range(len(cut.columns))]
    run = F.pmod(F.xxhash64(*named), F.lit(RUNS)).cast("int")
    rows = cut.toDF(*named).withColumn("n", F.col(named[cut.columns.index("length")]).cast("long")).withColumn("run", run)
    counts = stage(rows.groupBy("n", "run").agg(F.count("*").alias("rows")))
    before = Window.partitionBy("n").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("n", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    lengths = {r.n: r.rows for r in counts.groupBy("n").agg(F.sum("rows").alias("rows")).collect()}
    if any(not 1 <= n <= capacity for n in lengths):
        raise ValueError("a length is outside of 1 to the capacity")
    table = [(s.length, s.rank, s.rank + s.count, s.bin, s.each, s.offset) for s in plan(lengths, capacity)]
    # as an Arrow table: a list of rows would start a second Python daemon with workers of its own in each executor, and leave it there
    columns = np.array(table, "i8").reshape(-1, 6).T
    places = cut.sparkSession.createDataFrame(pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=["n", "low", "high", "bin", "each", "at"]))
    within = Window.partitionBy("n", "run").orderBy(*named)
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1).join(bases, ["n", "run"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(places), (ranked.n == places.n) & (ranked["rank"] >= places.low) & (ranked["rank"] < places.high))
    step = F.col("rank") - F.col("low")
    sequence = F.col("bin") + F.floor(step / F.col("each"))
    return placed.select(
        *(F.col(n).alias(c) for n, c in zip(named, cut.columns, strict=True)),
        sequence.cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("each") * ranked.n).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack all documents: a row for each piece, with its place. An empty table gives no row; repeated rows are packed each."""
    return pack(stage(pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)
