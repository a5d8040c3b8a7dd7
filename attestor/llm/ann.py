"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.shared import BROADCAST_ROWS, bounded_sample, stage, unstage

#: Tables, by how many substrings are indexed; bits of a substring, and so many more whenever the rows outgrow its values, up to a most.
TABLES, BITS, MORE_BITS, MOST_BITS = (16, 32), 16, 4, 28
#: Buckets that differ in so many last bits of their substring lie together; of them, one task holds so many rows and queries at a time.
TOGETHER, SHARD, BLOCK = 11, 4096, 4096


@dataclass
class Model:
    """Codes are the signs of ``(x - mean) @ directions``; their first bits are cut into ``tables`` substrings of ``bits`` bits.

    A query probes each table with all values within ``near`` bits of its own substring. By the pigeonhole principle that finds every code
    within :attr:`radius` bits of the query's; codes beyond it that a table brings too are kept up to ``cut`` differing bits.
    """

    mean: np.ndarray
    directions: np.ndarray
    bits: int
    tables: int
    near: int
    cut: int

    @property
    def radius(self) -> int:
        return self.tables * (self.near + 1) - 1

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(substrings, whole code as bytes) of each vector."""
        on = (x - self.mean) @ self.directions > 0
        subs = on.reshape(len(x), -1, self.bits) @ (1 << np.arange(self.bits, dtype="i8"))
        return subs[:, : self.tables], np.packbits(on, axis=1)

    def tables_that_meet(self, differ: np.ndarray) -> np.ndarray:
        """For differing bits of whole codes, as bytes: which tables' substrings differ in ``near`` bits at most."""
        on = np.unpackbits(differ, axis=1, count=self.directions.shape[1]).reshape(len(differ), self.directions.shape[1] // self.bits, self.bits)
        return on[:, : self.tables].sum(2) <= self.near

    @property
    def lead(self) -> int:
        """First bits of a substring, by which buckets are grouped."""
        return max(0, self.bits - TOGETHER)

    def masks(self) -> np.ndarray:
        """All patterns of at most ``near`` set bits among the first ones."""
        sets = itertools.chain.from_iterable(itertools.combinations(range(self.lead), n) for n in range(min(self.near, self.lead) + 1))
        return np.array([sum(1 << i for i in s) for s in sets], "i8")


def usable(vector: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def _rotation(x: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """Principal axes, and on them an orthogonal rotation fitted in turns with the signs, so that codes lose little."""
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def _truth(index: DataFrame, x: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """(place in ``x``, neighbour's vector): the ``k`` nearest rows of the whole index to each of a few vectors, in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, "i8"), np.zeros((0, x.shape[1])))] * len(x)
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                ids, v = part.column(0).to_numpy(), matrix(part.column(1))
                far = (v * v).sum(1) - 2 * (x @ v.T)  # the query's own square is the same for all
                for i, d in enumerate(far):
                    some = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                    near, at, held = (np.concatenate(p) for p in zip(best[i], (d[some], ids[some], v[some]), strict=True))
                    top = np.lexsort((at, near))[: k + 1]
                    best[i] = near[top], at[top], held[top]
        for i, (near, at, held) in enumerate(best):
            listed = pa.array(held.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(near), pa.array(at), listed], names=["key", "score", "id", "v"])

    found = _nearest(index.mapInArrow(work, "key long, score double, id long, v array<double>"), "key", k + 1)
    return [(r.key, np.array(r.v)) for r in found.where("rank > 1").collect()]  # the first is the vector itself


def fit(vectors: DataFrame, rows: int, k: int = 10, sample: int = 20_000, queries: int = 200, recall: float = 0.95, kept: float = 0.99, rounds: int = 12) -> Model | None:
    """Learn from at most ``sample`` of the ``rows`` rows of (id, v), the same ones at each run. None without rows.

    Codes come from as many rotations, each fitted from another start, as their bits need. A substring has at least as many values as
    there are ``rows``, so that a bucket holds about one row. Of all numbers of tables and of differing bits a table, the one
    with the fewest probes is taken that brings ``recall`` of the true ``k`` nearest, among all rows, of ``queries`` sampled ones; and
    whole codes may differ as much as those of a share ``kept`` of these.
    """
    taken = bounded_sample(vectors, F.col("id"), sample).select("v").toArrow()
    if not len(taken):
        return None
    x = matrix(taken.column("v"))
    mean, bits = x.mean(0), BITS
    while rows > 1 << bits and bits < MOST_BITS:
        bits += MORE_BITS
    need = -(-TABLES[-1] * bits // x.shape[1])
    directions = np.concatenate([_rotation(x[:4000] - mean, seed, rounds) for seed in range(need)], axis=1)[:, : TABLES[-1] * bits]
    truth = _truth(vectors, x[:queries], k)
    coder = Model(mean, directions, bits, TABLES[-1], 0, 0)
    asked = coder.codes(x[:queries])[0][[i for i, _ in truth]]
    apart = np.bitwise_count(asked ^ coder.codes(np.stack([v for _, v in truth]))[0]) if truth else np.zeros((0, TABLES[-1]), "i8")
    cost = lambda o: o[0] * sum(math.comb(bits, n) for n in range(o[1] + 1))
    for tables, near in sorted(itertools.product(TABLES, range(bits + 1)), key=cost):
        hit = (apart[:, :tables] <= near).any(1)
        if not len(hit) or hit.mean() >= recall:
            break
    whole = apart[hit].sum(1, dtype="i8")
    return Model(mean, directions, bits, tables, near, int(np.quantile(whole, kept, method="higher")) if len(whole) else TABLES[-1] * bits)


PLACED = "id long, code binary, t int, lead int, sub int, q boolean"


def _placed(rows: DataFrame, model: Model, probing: bool) -> DataFrame:
    """Rows (id, v) of the index at their substring in each table; or queries at all groups of buckets that they probe."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = model.masks() if probing else np.zeros(1, "i8")
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                subs, code = model.codes(matrix(part.column(1)))
                of = np.repeat(np.arange(len(part)), model.tables * len(masks))
                lead = ((subs >> (model.bits - model.lead))[:, :, None] ^ masks).reshape(-1)
                table = np.tile(np.repeat(np.arange(model.tables), len(masks)), len(part))
                columns = [part.column(0).take(pa.array(of)), pa.array([c.tobytes() for c in code], pa.binary()).take(pa.array(of)), pa.array(table.astype("i4")), pa.array(lead.astype("i4"))]
                sub = pa.array(np.repeat(subs.reshape(-1), len(masks)).astype("i4"))
                yield pa.RecordBatch.from_arrays([*columns, sub, pa.array(np.full(len(of), probing))], names=["id", "code", "t", "lead", "sub", "q"])

    return rows.mapInArrow(work, PLACED)


def _few(df: DataFrame) -> DataFrame:
    """Broadcast what is counted to be few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(index: DataFrame, asks: DataFrame, model: Model) -> DataFrame:
    """(key, id), each once: rows of ``index`` (id, v) whose code is near that of a row of ``asks`` (key, v).

    Rows and probes are shuffled on (table, first bits of the substring), so that buckets meet their probes in groups; a group with many
    rows or probes is dealt into a grid of bounded blocks. Substrings and whole codes are compared there; a pair
    that several tables bring leaves in the first. No vector goes along.
    """
    rows, probes = _placed(index, model, False), stage(_placed(asks.select("key", "v"), model, True))
    deal = lambda df, most, name: df.groupBy("t", "lead").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = stage(deal(rows, SHARD, "shards").join(deal(probes, BLOCK, "blocks"), ["t", "lead"]))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    one = lambda n: (spread % F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["t", "lead", "sub", "id", "code", "q"]
    met = rows.join(grid, ["t", "lead"]).select(*columns, one("shards").alias("shard"), each("blocks").alias("block"))
    met = met.unionByName(probes.join(grid, ["t", "lead"]).select(*columns, each("shards").alias("shard"), one("blocks").alias("block")))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        q, ids, sub = group["q"].to_numpy(bool), group["id"].to_numpy(), group["sub"].to_numpy()
        code = np.frombuffer(b"".join(group["code"]), "u1").reshape(len(group), -1)
        asked, held, table = np.flatnonzero(q), np.flatnonzero(~q), int(group["t"].iloc[0])
        out = [pd.DataFrame({"key": pd.Series(dtype="i8"), "id": pd.Series(dtype="i8")})]
        for first in range(0, len(asked), 256):
            some = asked[first : first + 256]
            a, b = np.nonzero(np.bitwise_count(sub[some][:, None] ^ sub[held]) <= model.near)
            for at in range(0, len(a), 1 << 17):
                x, y = some[a[at : at + (1 << 17)]], held[b[at : at + (1 << 17)]]
                differ = code[x] ^ code[y]
                near = np.flatnonzero(np.bitwise_count(differ).sum(1, dtype="i8") <= model.cut)
                near = near[model.tables_that_meet(differ[near]).argmax(1) == table]
                out.append(pd.DataFrame({"key": ids[x[near]], "id": ids[y[near]]}))
        return pd.concat(out[1:] or out)

    found = stage(met.groupBy("t", "lead", "shard", "block").applyInPandas(meet, "key long, id long"))
    unstage(probes)
    unstage(grid)
    return found


def _distances(pairs: DataFrame) -> DataFrame:
    """(key, id, score) of (key, id, v, q): Euclidean distances in double precision."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(((matrix(batch.column(2)) - matrix(batch.column(3))) ** 2).sum(1)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["key", "id", "score"])

    return pairs.select("key", "id", "v", "q").mapInArrow(work, "key long, id long, score double")


def _nearest(found: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` nearest of each ``by``, with their ``rank``; ties go to smaller ids."""
    order = Window.partitionBy(by).orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole(index: DataFrame, asks: DataFrame, rows: int, asked: int, k: int) -> DataFrame:
    """(key, id, score) of the ``k`` nearest within each shard of the rows, for queries whose radius is the whole code."""
    shards, blocks = max(1, -(-rows // SHARD)), max(1, -(-asked // BLOCK))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    listed = index.select(spread("id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", F.lit(False).alias("q"))
    given = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), spread("key", blocks).alias("block"), F.col("key").alias("id"), "v", F.lit(True).alias("q"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        q, ids, x = group["q"].to_numpy(bool), group["id"].to_numpy(), np.stack(group["v"].to_numpy()).astype("f8")
        out = [pd.DataFrame({"key": pd.Series(dtype="i8"), "id": pd.Series(dtype="i8"), "score": pd.Series(dtype="f8")})]
        for key, vector in zip(ids[q], x[q], strict=True):
            d = np.sqrt(((x[~q] - vector) ** 2).sum(1))
            best = np.lexsort((ids[~q], d))[:k]
            out.append(pd.DataFrame({"key": key, "id": ids[~q][best], "score": d[best]}))
        return pd.concat(out[1:] or out)

    return listed.unionByName(given).groupBy("shard", "block").applyInPandas(meet, "key long, id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` holds for, its ``k`` nearest other rows found.

    Score is the Euclidean distance of the original vectors in double precision, ties go to smaller ids, null ids last. Rows
    that are not :func:`usable` take no part; vectors of different lengths are never neighbours. Repeated rows, and rows that share an id, are rows of their own: each
    is a candidate of the others, and each that is a query has its own ``k`` nearest. Other columns are ignored.

    Rows are numbered in the order of their ids, and only these numbers are joined on. All rows are indexed. Of equal vectors the ``k + 1`` of least number are, since no
    other can be among the nearest; equal queries are asked once. Buckets are probed by :func:`candidates`; a query that finds fewer than ``k`` others this way meets all
    rows, in blocks.
    """
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("own"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = stage(rows.orderBy(F.asc_nulls_last("own")).withColumn("id", F.monotonically_increasing_id()))
    out = None
    for size in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        part = _search(rows.where(F.size("v") == size), k)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double") if out is None else out


def _search(rows: DataFrame, k: int) -> DataFrame:
    """:func:`search` over rows (id, own, v, q) of one length; ``id`` is a row's number, ``own`` its id."""
    copies = Window.partitionBy("v").orderBy("id")
    index = stage(rows.select("id", "v").withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).drop("nth"))
    asks = stage(rows.where("q").groupBy("v").agg(F.min("id").alias("key")))
    n, asked = index.count(), asks.count()
    model = fit(index, n, k)
    found = candidates(index, asks, model)
    enough = found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > k).select("key")
    short = stage(asks.join(enough, "key", "left_anti"))
    own = asks.select("key", F.col("v").alias("q"))
    met = _distances(found.join(enough, "key", "left_semi").join(index, "id").join(_few(own) if asked else own, "key"))
    if lacking := short.count():
        met = met.unionByName(_whole(index, short, n, lacking, k + 1))
    best = _nearest(met, "key", k + 1).drop("rank")
    queries = rows.where("q").join(asks, "v").select(F.col("id").alias("asker"), F.col("own").alias("query_id"), "key")
    found = _nearest(queries.join(best, "key").where("id <> asker").drop("key"), "asker", k)
    return found.join(rows.select("id", "own"), "id").select("query_id", "rank", F.col("own").alias("id"), "score")
